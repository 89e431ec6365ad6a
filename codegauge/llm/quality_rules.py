"""Quality rules as a short-circuit cascade.

A rule reads a few statistics of a text and rejects it or not; a text is kept if no rule rejects it, so the
order of the rules changes the cost alone. The order is found on a sample: each rule's seconds a document
and the share it rejects, then most rejections per second first. A rule is run only on texts that all
rules before it let pass, and a statistic is computed when first asked for.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SPACES, SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
WINDOW = 8
#: The rules are ordered on about so many documents, whatever the size of the corpus.
SAMPLE_DOCS = 2000


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of so many words that the text holds twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = dict.fromkeys(words)
    if len(ids) == len(words):
        return 0
    for i, w in enumerate(ids):
        ids[w] = i
    x = np.fromiter(map(ids.__getitem__, words), np.uint64, len(words))
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n] + np.uint64(1)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    same = np.flatnonzero(h[order[1:]] == h[order[:-1]])
    if not len(same):
        return 0
    a, b = order[same], order[same + 1]
    real = (x[a[:, None] + np.arange(window)] == x[b[:, None] + np.arange(window)]).all(axis=1)  # equal hashes are not taken on trust
    marks = np.zeros(len(words) + 1, np.int64)
    twice = np.unique(np.concatenate([a[real], b[real]]))
    marks[twice] += 1
    marks[twice + window] -= 1
    return int((np.cumsum(marks) > 0).sum())


class Text:
    """A whole text and its statistics, each computed when first asked for. A null text is an empty one."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def raw(self) -> bytes:
        return self.text.encode()

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - (len(self.raw) - len(self.raw.translate(None, SPACES)))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.raw) - len(self.raw.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        return repeated_words(self.words)

    @cached_property
    def n_stutters(self) -> int:
        """Words equal to the word before."""
        return sum(map(bytes.__eq__, self.words[1:], self.words))

    @cached_property
    def n_upper(self) -> int:
        """Capital letters: what is upper case and no numeral or circled sign."""
        return sum(map(str.isupper, self.text)) - (0 if self.text.isascii() else len(_SIGNS.findall(self.text)))


#: Fixed value: Roman numerals, and circled and squared letters, which are upper case and no letters of the class Lu.
_SIGNS = re.compile("[\u2160-\u216f\u24b6-\u24cf\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189]")


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Text], bool]
    base: bool = False


#: The first two are the contract's; the others reject what no running prose is.
RULES = (
    Rule("few_words", lambda t: t.n_words < 20, base=True),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words, base=True),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("stutters", lambda t: 10 * t.n_stutters > 3 * t.n_words),
    Rule("word_length", lambda t: not 2 * t.n_words <= t.word_chars <= 15 * t.n_words),
    Rule("repeated_lines", lambda t: 10 * t.n_dup_lines > 5 * len(t.lines)),
    Rule("capitals", lambda t: 2 * t.n_upper > t.word_chars),
)
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def order_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_DOCS) -> tuple[Rule, ...]:
    """The rules, most rejections per second first, by a sample measured on the executors."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent, hits, n = [0.0] * len(rules), [0] * len(rules), 0
        for pdf in frames:
            n += len(pdf)
            for text in pdf["text"]:
                for k, r in enumerate(rules):
                    t = Text(text)  # a rule pays for all that it reads
                    begin = time.perf_counter()
                    hits[k] += bool(r.rejects(t))
                    spent[k] += time.perf_counter() - begin
        yield pd.DataFrame({"k": range(len(rules)), "spent": spent, "hits": hits, "n": n})

    total = docs.count()
    part = docs.select("text") if total <= sample else docs.select("text").sample(fraction=min(1.0, 2 * sample / total), seed=11).limit(sample)
    rows = part.mapInPandas(measure, "k int, spent double, hits long, n long").groupBy("k").agg(F.sum("spent"), F.sum("hits"), F.sum("n")).collect()
    gain = {k: (hits + 0.5) / (spent + 1e-9) for k, spent, hits, _ in rows}  # half a hit: a rule that met none stays comparable
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: (-gain.get(k, 0.0), k)))


def first_rejection(text: Text, ordered: tuple[Rule, ...]) -> str | None:
    return next((r.name for r in ordered if r.rejects(text)), None)


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, stats: tuple[str, ...] = STATS, sample: int = SAMPLE_DOCS) -> DataFrame:
    """One row for each row of docs: doc_id, the named statistics (long), base_failed, kept, rejected_by.

    rejected_by is the first rule of the cascade that rejects (its order is measured and may differ from run
    to run where several rules reject; kept does not). Null, empty and wordless texts have 0 everywhere and fail
    the base. Whole texts are read, however long. Rows that repeat are judged alike; only doc_id (null allowed) and
    text are read, so extra columns do no harm; an empty table gives no rows.
    """
    ordered = order_rules(docs, rules, sample)
    base = [r for r in rules if r.base]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(len(stats) + 3)]
            for x in b.column(1):
                t = Text(x.as_py())
                why = first_rejection(t, ordered)
                for c, s in zip(cols, stats):
                    c.append(getattr(t, s))
                cols[-3].append(why is not None and any(r.rejects(t) for r in base))
                cols[-2].append(why is None)
                cols[-1].append(why)
            kinds = [pa.int64()] * len(stats) + [pa.bool_(), pa.bool_(), pa.string()]
            yield pa.record_batch([b.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=["doc_id", *stats, "base_failed", "kept", "rejected_by"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + "".join(f"{s} long, " for s in stats) + "base_failed boolean, kept boolean, rejected_by string")


def kept_rows(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE_DOCS) -> DataFrame:
    """docs without the rejected rows, all columns as they were; only text goes to Python."""
    ordered = order_rules(docs, rules, sample)

    def passes(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda x: first_rejection(Text(x), ordered) is None).astype(bool)
        shared.release_memory()

    passes.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.where(F.pandas_udf(passes, "boolean")("text"))
