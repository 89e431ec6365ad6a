"""Packing token sequences of at most CAPACITY tokens by exact complements, then best fit.

Lengths lie between 1 and CAPACITY, so all that decides the packing is how many pieces have each length: at
most CAPACITY numbers, whatever the corpus. `plan` works on those counts. For each length, from the longest, it
fills the gap exactly with one, two or three available lengths, found by their sum, as often as the
counts allow; what has no exact complement is packed best fit, longest first. The plan is a short list of patterns
with multiplicities. Each piece then looks its place up by (length, rank among the pieces of that length);
ranks come from counts per written partition, so no length gathers in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, tokens

CAPACITY, END = 1024, 2


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only longer ones are cut, and the first piece may be shorter."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _fill(avail: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to gap, the fewest and then the longest first; or None."""
    if gap < len(avail) and avail[gap]:
        return (gap,)
    have = np.flatnonzero(avail[: gap + 1])
    have = have[have > 0][::-1]  # longest first
    b = gap - have
    two = (b > 0) & (b <= have) & (avail[np.clip(b, 0, None)] >= np.where(b == have, 2, 1))
    if two.any():
        a = int(have[np.argmax(two)])
        return (a, gap - a)
    for a in have.tolist():  # a >= b >= c
        if 3 * a < gap:
            break
        left = gap - a
        mid = have[(have <= a) & (have < left)]
        c = left - mid
        need = 1 + (c == mid).astype(np.int64) + ((c == a) & (mid == a))
        ok = (c > 0) & (c <= mid) & (avail[c] >= need) & (avail[mid] >= np.where(mid == a, 2, 1))
        if ok.any():
            return (a, int(mid[np.argmax(ok)]), int(c[np.argmax(ok)]))
    return None


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[tuple[int, int]], int]]:
    """[([(length, pieces in a sequence), ...], sequences)] that uses counts[length] pieces of each length, exactly.

    Each step uses up a length or closes a gap, so the list is bounded by capacity, not by the counts.
    """
    avail = counts.astype(np.int64).copy()
    out: list[tuple[list[tuple[int, int]], int]] = []
    if avail[capacity]:
        out.append(([(capacity, 1)], int(avail[capacity])))
        avail[capacity] = 0
    rest = []
    for length in range(capacity - 1, 0, -1):
        while avail[length]:
            avail[length] -= 1  # one piece stands for those that get the same complement
            found = _fill(avail, capacity - length)
            avail[length] += 1
            if found is None:
                rest.append((length, int(avail[length])))
                avail[length] = 0
                break
            uses: dict[int, int] = {}
            for x in (length, *found):
                uses[x] = uses.get(x, 0) + 1
            times = min(int(avail[x]) // k for x, k in uses.items())
            for x, k in uses.items():
                avail[x] -= times * k
            out.append((list(uses.items()), times))
    # Best fit, longest first: bins with the same content stand together as (gap, pattern, how many).
    bins: list[list] = []
    for length, n in rest:
        while n:
            fit = min((b for b in bins if b[0] >= length), key=lambda b: b[0], default=None)
            if fit is None:
                k = capacity // length
                for k, m in ((k, n // k), (n % k, 1)):
                    if k and m:
                        bins.append([capacity - k * length, [(length, k)], m])
                n = 0
                continue
            k = min(fit[0] // length, n)
            m = min(fit[2], n // k)
            fit[2] -= m
            bins.append([fit[0] - k * length, [*fit[1], (length, k)], m])
            n -= k * m
            bins = [b for b in bins if b[2]]
    return out + [(p, m) for _, p, m in bins]


def slots(patterns: list[tuple[list[tuple[int, int]], int]]) -> dict[str, np.ndarray]:
    """The plan as ranges of ranks: pieces `low`.. of `length` go to sequence base + (rank - low) // k at offset + (rank - low) % k * length."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pattern, m in patterns:
        offset = 0
        for length, k in pattern:
            low = used.get(length, 0)
            used[length] = low + m * k
            rows.append((length, low, base, k, offset))
            offset += length * k
        base += m
    rows.sort()
    names = ("length", "low", "base", "k", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth): each document's pieces; nth ranks a length inside its part."""
    path = path or tokens.vocabulary_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(capacity + 1, np.int64)
        part, coder = TaskContext.get().partitionId(), tokens.encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows: list[tuple] = []
                flat, sizes = coder.ids_of(batch.column(1).slice(at, 500).to_pylist())
                ends = np.cumsum(sizes)
                whole = np.insert(flat, ends, end).astype("<u4")
                raw, low = memoryview(whole.tobytes()), 0
                for i, n in enumerate((sizes + 1).tolist()):
                    for j, (s, k) in enumerate(cut(n, capacity)):
                        rows.append((at + i, j, s, k, zlib.crc32(raw[4 * (low + s) : 4 * (low + s + k)]), part, int(seen[k])))
                        seen[k] += 1
                    low += n
                cols = list(zip(*rows))
                yield pa.record_batch([batch.column(0).take(pa.array(cols[0])), pa.array(cols[1], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[2:5]], pa.array(cols[5], pa.int32()), pa.array(cols[6], pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])
        coder.forget()

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row for each piece of each row of docs: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its whole text (null: none) and the end id, so even an empty one is a piece of
    length 1. Rows that repeat are packed each for itself; null ids stay null. Only doc_id and text are read. An
    empty table gives no rows. Sequences hold at most `capacity` ids, without gaps.
    """
    got = shared.written(pieces(docs, path, capacity, end), "pieces")
    by_part = got.groupBy("part", "length").agg(F.count("*").alias("n"))
    by_part = shared.written(by_part, "lengths")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in by_part.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        counts[length] = n
    at = slots(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = got.join(first.hint("merge"), ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = (at["length"] << 50) | at["low"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            i = np.searchsorted(keys, (length << 50) | rank, side="right") - 1
            step = rank - at["low"][i]
            seq, off = at["base"][i] + step // at["k"][i], at["offset"][i] + step % at["k"][i] * length
            yield pa.record_batch([*b.columns[:5], pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
