"""Periodic runs of words: maximal stretches that repeat with some period, found by way of longest previous factors.

Of each text, over its words: the suffix array by prefix doubling; from it and the common prefixes of neighbours the longest
previous factor of each position; from those the Lempel-Ziv blocks. A run either touches the start of a block, and then Main's
extensions to both sides of that place find it, or lies strictly inside a block, and then is a copy of a run inside the
block's source: runs are kept in buckets by start and copied from left to right.

Many texts are worked on together: words of different texts are different symbols, and a symbol of its own ends each text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared

EXPONENT, LEAST = 4, 6
#: Words that are worked on together; a longer text is worked on alone.
LOT = 1 << 17


class Suffixes:
    """Suffix array of symbols in which the first and the last one, and one in each text, occur nowhere else.

    ranks[k][i] tells stretches of 2 ** k symbols apart by where they start; both extensions are read from it.
    """

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.order = order = np.argsort(symbols, kind="stable")
        head = np.append(True, symbols[order[1:]] != symbols[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.ranks, width = [rank], 1
        while len(at := np.flatnonzero(~(head & np.append(head[1:], True)))):  # stretches that still have equals
            if len(self.ranks) < width.bit_length():
                self.ranks.append(rank)
            places = order[at]
            key = rank[places] * n + rank[places + width]
            by = np.argsort(key, kind="stable")
            places, key = places[by], key[by]
            new = np.append(True, key[1:] != key[:-1])
            order[at] = places
            head[at] = new
            rank = rank.copy()
            rank[places] = np.maximum.accumulate(np.where(new, at, 0))
            width *= 2
        self.top = len(self.ranks)

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on; i and j differ."""
        out = np.zeros(len(i), np.int64)
        for k in range(self.top - 1, -1, -1):
            r = self.ranks[k]
            out += (r[i + out] == r[j + out]).astype(np.int64) << k
        return out

    def before(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols up to i, i included, equal those up to j."""
        out = np.zeros(len(i), np.int64)
        for k in range(self.top - 1, -1, -1):
            r = self.ranks[k]
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            out += ((np.minimum(a, b) >= 0) & (r[np.maximum(a, 0)] == r[np.maximum(b, 0)])).astype(np.int64) << k
        return out


def _nearest_less(values: np.ndarray) -> np.ndarray:
    """For each place the nearest place to its left with a lesser value; -1 if there is none."""
    n = len(values)
    least, width = [values], 1
    out = np.arange(n) - 1  # all places right of `out` are known to be greater
    while 2 * width <= n:
        low = least[-1].copy()
        low[width:] = np.minimum(least[-1][width:], least[-1][:-width])
        least.append(low)
        width *= 2
        if not (low[:-1] > values[1:]).any():  # nobody skips as much as this
            break
    for k in range(len(least) - 1, -1, -1):
        far = out - (1 << k) + 1 >= 0
        out[far & (least[k][np.maximum(out, 0)] > values)] -= 1 << k
    out[(out >= 0) & (values[np.maximum(out, 0)] > values)] = -1
    return out


def previous_factors(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(length, place) of the longest stretch at each position that also starts at an earlier place."""
    n = len(s.order)
    length, source = np.zeros(n, np.int64), np.zeros(n, np.int64)
    first = s.ranks[0][s.order]  # the group of suffixes that begin with one symbol
    many = np.append(first[1:] == first[:-1], False) | np.append(False, first[1:] == first[:-1])
    at, group = s.order[many], first[many]
    if not len(at):
        return length, source
    # Suffixes of other groups are less than any of this one, to the left and to the right: the search ends there.
    left = _nearest_less(at + group * n)
    right = len(at) - 1 - _nearest_less((at - group * n)[::-1])[::-1]
    for near, known in ((left, left >= 0), (right, right < len(at))):
        known &= group[np.clip(near, 0, len(at) - 1)] == group
        i, j = at[known], at[near[known]]
        same = s.after(i, j)
        better = same > length[i]
        length[i[better]], source[i[better]] = same[better], j[better]
    return length, source


def blocks(length: np.ndarray) -> np.ndarray:
    """Where the Lempel-Ziv blocks start, each as long as the longest previous factor or one symbol."""
    out, i, step = [], 0, np.maximum(length, 1).tolist()
    while i < len(step):
        out.append(i)
        i += step[i]
    return np.array(out, np.int64)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which, number from 1) for each unit of counts."""
    which = np.repeat(np.arange(len(counts)), counts)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + 1


def _touching(s: Suffixes, starts: np.ndarray, text_start: np.ndarray) -> np.ndarray:
    """(start, end, period) of runs that touch a block's start, each once with its smallest period, in order.

    A run of period p has at least p symbols before or after the place b. After it, p is at most the block's length; before it, at most
    that and the length of the block before: else the block before would have been longer.
    """
    n, symbol = len(s.order), s.ranks[0]
    size = np.diff(starts, append=n)
    found = []
    which, p = _spread(np.minimum(size, n - 1 - starts))
    b = starts[which]
    sides = [(b, b + p)]
    which, p = _spread(np.clip(starts - text_start[starts], 0, size + np.append(0, size[:-1])))
    b = starts[which]
    sides.append((b - p, b))
    for i, j in sides:  # symbols at i and j = i + p are compared, to the right and to the left
        kept = i > 0
        i, j = i[kept], j[kept]
        kept = (symbol[i] == symbol[j]) | (symbol[i - 1] == symbol[j - 1])
        i, j = i[kept], j[kept]
        ahead, behind = s.after(i, j), s.before(i - 1, j - 1)
        run = ahead + behind >= j - i
        found.append(np.stack([(i - behind)[run], (j + ahead)[run], (j - i)[run]], axis=1))
    found = np.concatenate(found)
    found = found[np.lexsort(found.T[::-1])]
    return found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(axis=1))] if len(found) else found


def _copied(runs: np.ndarray, starts: np.ndarray, length: np.ndarray, source: np.ndarray, text: np.ndarray) -> list[tuple[int, int, int]]:
    """The runs and their copies strictly inside blocks."""
    bucket = defaultdict(list)
    for start, end, period in runs.tolist():
        bucket[start].append((end, period))
    inner = starts[(length[starts] >= 4) & np.isin(text[starts], text[runs[:, 0]])]
    for b, c, away in zip(inner.tolist(), (inner + length[inner]).tolist(), (inner - source[inner]).tolist()):
        for i in range(b + 1, c - 2):
            for end, period in bucket.get(i - away, ()):
                if end + away < c:
                    bucket[i].append((end + away, period))
    return [(start, end, period) for start, ends in bucket.items() for end, period in ends]


def runs_of(texts: Sequence[Sequence[bytes]], exponent: int = 2, least: int = 2) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs in each list of words, by start, then period.

    A run's period is its smallest one, its length at least `exponent` periods (2 or more) and `least` words.
    """
    code: defaultdict[bytes, int] = defaultdict()
    code.default_factory = code.__len__
    sizes = np.array([len(w) for w in texts], np.int64)
    text = np.append(0, np.repeat(np.arange(1, len(texts) + 1), sizes + 1))  # a symbol before the first text, and one after each
    word = np.full(len(text), -1, np.int64)
    inside = np.ones(len(text), bool)
    inside[np.append(0, np.cumsum(sizes + 1))] = False
    word[inside] = [c for words in texts for c in map(code.__getitem__, words)]
    begin = np.append(1, np.cumsum(sizes + 1) + 1)
    s = Suffixes(text * (len(code) + 1) + word + 1)
    length, source = previous_factors(s)
    starts = blocks(length)
    runs = _touching(s, starts, begin[np.maximum(text - 1, 0)])
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if len(runs):
        for start, end, period in sorted(_copied(runs, starts, length, source, text)):
            if end - start >= max(least, exponent * period):
                k = int(text[start]) - 1
                out[k].append((start - int(begin[k]), end - start, period))
    return out


def kept_words(words: Sequence[bytes], runs: Sequence[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run has after its first period."""
    if not runs:
        return list(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def lots(texts: Sequence[str | None], lot: int = LOT) -> Iterator[list[list[bytes]]]:
    """The texts' words, as many texts together as have `lot` words."""
    part, held = [], 0
    for t in texts:
        words = t.encode().split() if t else []
        if part and held + len(words) > lot:
            yield part
            part, held = [], 0
        part.append(words)
        held += len(words)
    if part:
        yield part


def collapsed(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """docs' doc_id with the runs of each text and the text without repeated periods.

    Columns: doc_id, n_words, runs (array of start, length, period, by start and period), collapsed (kept words joined by one
    space), runs_sha256 (of a line `start,length,period` for each run), collapsed_sha256. Only doc_id and text are read, so that other
    columns of any name do no harm. Null and empty texts have no words and no runs; repeated rows each have a row; an
    empty table gives none. A text is worked on whole, whatever its length: memory is some 200 bytes a word of the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in batches:
            at = 0
            for part in lots(b.column(1).to_pylist()):
                runs = runs_of(part, exponent, least)
                texts = [b" ".join(kept_words(w, r)) for w, r in zip(part, runs)]
                lines = ["".join("%d,%d,%d\n" % x for x in r).encode() for r in runs]
                columns = [
                    b.column(0).slice(at, len(part)), pa.array([len(w) for w in part], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in runs], pa.list_(fields)), pa.array([t.decode() for t in texts], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in lines]), pa.array([hashlib.sha256(x).hexdigest() for x in texts]),
                ]
                yield pa.record_batch(columns, names=["doc_id", "n_words", "runs", "collapsed", "runs_sha256", "collapsed_sha256"])
                at += len(part)
        shared.release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
