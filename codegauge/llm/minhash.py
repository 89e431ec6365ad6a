"""MinHash candidates and links that are verified on the items themselves.

A signature is cut into bands; items that agree in a whole band are candidates. Two sets of Jaccard similarity s share one
with probability 1 - (1 - s ** rows) ** bands. Candidates are then verified, so what is linked is similar.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


SYMBOLS = 24


def factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 64, n, np.uint64) | np.uint64(1), rng.integers(0, 1 << 64, n, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def band_keys(hashes: np.ndarray, first: np.ndarray, bands: int, rows: int, scale: np.ndarray | None = None, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """([run, band] keys, sketch) of each run of 64-bit hashes (they start at `first`, none is empty).

    scale: what each hash is multiplied with before the least is taken, 1 to 4,095; one of scale 64 is taken about 64
    times as seldom as one of scale 1. The sketch has two bits of each of the first SYMBOLS least hashes: sets of similarity s
    differ in about three quarters of (1 - s) of them. Keys of different seeds are never equal but by chance.
    """
    times, plus = factors(bands * rows)
    out, sketch = np.zeros((len(first), bands), np.uint64), np.zeros(len(first), np.uint64)
    value = np.empty_like(hashes)
    for band in range(bands):
        key = np.full(len(first), band + 1 + (seed << 32), np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            np.multiply(hashes, times[k], out=value)
            value += plus[k]
            if scale is not None:
                value >>= np.uint64(12)
                value *= scale
            least = mixed(np.minimum.reduceat(value, first))
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
            if k < SYMBOLS:
                sketch |= (least & np.uint64(3)) << np.uint64(2 * k)
        out[:, band] = key
    return out.view(np.int64), sketch


def sketches_differ(a: Column, b: Column) -> Column:
    """In how many of the SYMBOLS two sketches differ (bits above them are left out)."""
    x = a.bitwiseXOR(b)
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit((1 << 2 * SYMBOLS) // 3)))


#: Keys that a task packs at a time, keys of a bucket on average, and items of a key in a lot from which they are led there.
LOT, BUCKET, OFTEN = 1 << 19, 1 << 17, 8
_PLAIN, _LEADS, _DONE = 0, 1, 2


def _grouped(k: np.ndarray, h: np.ndarray, x: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows sorted by (k, h), each (k, h) once (led if any is), then where each k begins and how many rows it has."""
    order = np.lexsort((h, k))
    k, h, x, led = k[order], h[order], x[order], led[order]
    at = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
    k, h, x, led = k[at], h[at], x[at], np.logical_or.reduceat(led, at)
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k, h, x, led, first, np.diff(first, append=len(k))


def _blobs(kind: int, bucket: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """A row (bucket, kind, blob) for each run of equal buckets; the blob has the run's values row by row."""
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    data = np.ascontiguousarray(np.stack([c.view(np.int64) for c in columns], axis=1))
    offsets = (np.append(cuts, len(bucket)) * 8 * len(columns)).astype(np.int32)
    blob = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.record_batch([pa.array(bucket[cuts].astype(np.int32)), pa.array(np.full(len(cuts), kind, np.int32)), blob], names=["bucket", "kind", "blob"])


def _packed_lot(k: np.ndarray, h: np.ndarray, x: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """A lot's keys by bucket. Of a key that many items of the lot have, the rows are made here; its lead alone goes on."""
    place = lambda v: ((v >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(k)
    k, h, x = k[order], h[order], x[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    size = np.diff(first, append=len(k))
    often = np.repeat(size >= OFTEN, size)
    if often.any():
        gk, gh, gx, _, first, size = _grouped(k[often], h[often], x[often], np.zeros(int(often.sum()), bool))
        for kind, chosen in ((_PLAIN, first[size == 1]), (_LEADS, first[size > 1])):
            if len(chosen):
                yield _blobs(kind, place(gk[chosen]), gk[chosen], gh[chosen], gx[chosen])
        rows = np.repeat(size > 1, size)
        lead = np.repeat(first, size)[rows]
        if len(lead):  # rows that are done need no bucket: they go anywhere
            yield _blobs(_DONE, -1 - (np.arange(len(lead)) // 4096 + int(gk[0] & np.uint64(0xFFFF))), gk[rows], gh[rows], gx[rows], gh[lead], gx[lead])
        k, h, x = k[~often], h[~often], x[~often]
    if len(k):
        yield _blobs(_PLAIN, place(k), k, h, x)


def _packed(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, held = [], 0
        for b in batches:
            count = np.diff(b.column(2).offsets.to_numpy())
            lot.append((b.column(2).flatten().to_numpy().view(np.uint64), *(np.repeat(b.column(c).to_numpy(), count) for c in (0, 1))))
            held += len(lot[-1][0])
            if held >= LOT:
                yield from _packed_lot(*map(np.concatenate, zip(*lot)), buckets)
                lot, held = [], 0
        if held:
            yield from _packed_lot(*map(np.concatenate, zip(*lot)), buckets)
        shared.release_memory()

    return run


def _shared_rows(parts: list[tuple[bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """The rows of a bucket's keys that several items share. parts: (led in their lots, rows of k, h, x)."""
    if not parts:
        return
    led = np.concatenate([np.full(len(rows), lot_led) for lot_led, rows in parts])
    rows = np.concatenate([rows for _, rows in parts])
    order = np.argsort(rows[:, 0])
    k = rows[order, 0]
    same = k[1:] == k[:-1]
    order = order[np.append(same, False) | np.append(False, same)]
    if len(order):
        k, h, x, led, first, size = _grouped(rows[order, 0], rows[order, 1], rows[order, 2], led[order])
        more = (size > 2) | np.logical_or.reduceat(led, first)
        rows, lead = np.repeat(size > 1, size), np.repeat(first, size)
        yield _rows(k[rows], h[rows], x[rows], h[lead][rows], x[lead][rows], np.repeat(more, size)[rows])


def _rows(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c) for c in columns], names=["k", "h", "x", "lead_h", "lead_x", "more"])


def _read(batches: Iterator[pa.RecordBatch], rows: Callable[[list[tuple[bool, np.ndarray]]], Iterator[pa.RecordBatch]], done: Callable[[np.ndarray], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, now = [], None
    for b in batches:
        for bucket, kind, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if bucket != now:
                yield from rows(parts)
                parts, now = [], bucket
            values = np.frombuffer(blob.as_buffer(), np.int64)
            if kind == _DONE:
                yield done(values.reshape(-1, 5))
            else:
                parts.append((kind == _LEADS, values.reshape(-1, 3)))
    yield from rows(parts)
    shared.release_memory()


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _read(batches, _shared_rows, lambda rows: _rows(*rows.T.copy(), np.ones(len(rows), bool)))


def forest(near: np.ndarray, best: np.ndarray | None = None, linked: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (i, j), i < j, that are near and linked; those of low `best` first, none inside what is linked already."""
    a, b = np.nonzero(near)
    if best is not None:
        order = np.argsort(best[a, b], kind="stable")
        a, b = a[order], b[order]
    root = list(range(len(near)))
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if joined(root, x, y, linked)]


def _found(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = x = root[root[x]]
    return x


def joined(root: list[int], x: int, y: int, linked: Callable[[int, int], bool] | None = None) -> bool:
    """Whether x and y were apart and are linked; then they are together."""
    if (p := _found(root, x)) == (q := _found(root, y)) or not (linked is None or linked(x, y)):
        return False
    root[p] = q
    return True


def joined_in_lots(root: list[int], a: np.ndarray, b: np.ndarray, linked: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Those of the pairs (a, b) that join what was apart, earlier ones first. `linked` is asked for many pairs at once, in lots that double, and not
    for those inside what the lots before have joined."""
    out, low, lot = [], 0, max(len(root), 64)
    while low < len(a):
        where = np.array([_found(root, i) for i in range(len(root))])
        apart = where[a[low:]] != where[b[low:]]
        a, b, low = a[low:][apart], b[low:][apart], 0
        if len(a):
            ok = linked(a[:lot], b[:lot])
            out += [(x, y) for x, y in zip(a[:lot][ok].tolist(), b[:lot][ok].tolist()) if joined(root, x, y)]
        low, lot = lot, min(2 * lot, 1 << 16)
    return out


#: Items of a group that one task compares with each other; items of a family of which all pairs are compared.
TOGETHER, WIDE = 512, 4096


def _bucket_ties(likely: Callable[[np.ndarray, np.ndarray], np.ndarray], parts: list[tuple[bool, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Ties between a bucket's items: a star for keys that are led in their lots or have very many items, else one for each part of a key that likely pairs hold together."""
    if not parts:
        return
    led = np.concatenate([np.full(len(rows), lot_led) for lot_led, rows in parts])
    rows = np.concatenate([rows for _, rows in parts])
    order = np.argsort(rows[:, 0])
    same = rows[order[1:], 0] == rows[order[:-1], 0]
    order = order[np.append(same, False) | np.append(False, same)]
    if not len(order):
        return
    _, h, x, led, first, size = _grouped(rows[order, 0], rows[order, 1], rows[order, 2], led[order])
    two = first[(size == 2)]
    two = two[likely(x[two], x[two + 1])]
    lead, item, whole = [two], [two + 1], [np.ones(len(two), bool)]
    star = np.logical_or.reduceat(led, first) | (size > TOGETHER)
    for low, n, all_of_them in zip(first[size > 2].tolist(), size[size > 2].tolist(), star[size > 2].tolist()):
        if all_of_them:
            least, more = np.full(n - 1, low), np.arange(low + 1, low + n)
        elif links := forest(np.triu(likely(x[low : low + n, None], x[low : low + n]), 1)):
            root = list(range(n))
            for i, j in links:  # i < j
                p, q = sorted((_found(root, i), _found(root, j)))
                root[q] = p
            least = np.array([_found(root, i) for i in range(n)])
            more = np.flatnonzero(least != np.arange(n))
            least, more = low + least[more], low + more
        else:
            continue
        lead.append(least), item.append(more), whole.append(np.full(len(more), not all_of_them))
    lead, item, whole = map(np.concatenate, (lead, item, whole))
    # A part's name is made of its items, whatever key holds them together.
    name = np.zeros(len(h), np.uint64)
    np.add.at(name, lead, mixed(h[item].view(np.uint64)))
    yield _ties(h[lead], h[item], mixed(name[lead] + mixed(h[lead].view(np.uint64))).view(np.int64), whole)


def _ties(a: np.ndarray, b: np.ndarray, part: np.ndarray, whole: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(a), pa.array(b), pa.array(part, mask=~whole)], names=["a", "b", "part"])


def ties(keys: DataFrame, likely: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b, part): of (k, h, x) pairs of items that share a key, such that likely items that share a key are tied together, if by others.

    `likely` tells from what keys carry of two items (uint64) whether they may be similar. k, h and x are as for `shared_keys`. Of a key come fewer
    ties than it has items. A key with more than TOGETHER items ties all of them, and part is null. Else part stands for all items that
    likely pairs of the key hold together: each of them is tied to one, and keys that hold the same items together give the same ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = lambda x, y: likely(x.view(np.uint64), y.view(np.uint64))
        yield from _read(batches, lambda parts: _bucket_ties(plain, parts), lambda rows: _ties(rows[:, 3], rows[:, 1], rows[:, 3], np.zeros(len(rows), bool)))

    return _exchanged(keys).mapInArrow(run, "a long, b long, part long").where("a <> b").distinct()


def parts(ties: DataFrame) -> DataFrame:
    """(h, part) of ties: each two likely items that share a key are in one part, and an item may be in several.

    What keys of very many items hold together is one part.
    """
    large = shared.components(ties.where("part is null"))
    return ties.where("part is not null").select(F.explode(F.array("a", "b")).alias("h"), "part").distinct().union(large)


def _values(column: pa.Array) -> list:
    """A column without nulls as Python has it, structs as tuples; sooner than by to_pylist."""
    if pa.types.is_struct(column.type):
        return list(zip(*map(_values, column.flatten())))
    return column.to_numpy(zero_copy_only=False).tolist()


def in_blocks(members: DataFrame, group: str, item: str, lots: Column, links: Callable[[list[dict]], list[tuple]], kind: str, data: list[str]) -> DataFrame:
    """(a, b) that `links` gives of the rows of each block; members: group, item and the columns of data.

    A group is dealt to so many lots; a block is a lot by itself or two lots, whose members have another `lot`. Each pair of members meets once.
    """
    members = members.withColumn("lots", lots.cast("int"))
    members = members.withColumn("lot", F.pmod(F.xxhash64(item, F.lit(7)), F.col("lots")).cast("int"))
    lot = F.col("lot")
    blocks = F.transform(F.sequence(F.lit(0), F.col("lots") - 1), lambda k: F.struct(F.least(lot, k).alias("i"), F.greatest(lot, k).alias("j")))
    members = members.select(group, item, "lot", F.explode(blocks).alias("block"), *data)
    members = members.select(F.struct(group, "block.i", "block.j").alias("block"), item, "lot", *data).repartition("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for row in (dict(zip(b.schema.names, r)) for r in zip(*map(_values, b.columns))):
                if held and row["block"] != held[0]["block"]:
                    yield from out(held)
                    held = []
                held.append(row)
        yield from out(held)
        shared.release_memory()

    def out(held: list[dict]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1 and (found := links(held)):
            yield pa.record_batch([pa.array(x) for x in zip(*found)], names=["a", "b"])

    return members.sortWithinPartitions("block").mapInArrow(run, f"a {kind}, b {kind}")


def met(rows: list[dict]) -> np.ndarray:
    """Which pairs (i, j), i < j, of a block's rows meet there: those of different lots, or all in a block of one lot."""
    once = np.triu(np.ones((len(rows), len(rows)), bool), 1)
    lot = np.array([r["lot"] for r in rows])
    return once & (lot[:, None] != lot) if lot.min() < lot.max() else once


def pairs_that_meet(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """`met` as pairs (a, b)."""
    lot = np.array([r["lot"] for r in rows])
    one = lot == lot[0]
    if one.all():
        return np.triu_indices(len(rows), 1)
    a, b = np.meshgrid(np.flatnonzero(one), np.flatnonzero(~one), indexing="ij")
    return a.reshape(-1), b.reshape(-1)


def _exchanged(keys: DataFrame) -> DataFrame:
    if keys.schema["k"].dataType.typeName() != "array":
        keys = keys.withColumn("k", F.array("k"))
    total = keys.agg(F.sum(F.size("k"))).first()[0] or 0
    packed = keys.select("h", "x", "k").mapInArrow(_packed(-(-total // BUCKET) or 1), "bucket int, kind int, blob binary")
    return packed.repartition("bucket").sortWithinPartitions("bucket")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(k, h, x) to (k, h, x, lead_h, lead_x, more) of the keys that several items h share; the lead is one of the key's items.

    k is a key or an array of keys, hashes that are spread evenly. An item may have several rows of a key. Where `more` is false
    the key has the lead and one other item. One exchange of packed keys: each task cuts its keys, in lots, by buckets of like size.
    A key that many items of a lot have is led there, and its lead alone goes to the key's bucket, where the lots' leads
    are led by the least of them: what a bucket holds of a key grows with the lots, whatever part of all items has the key.
    """
    return shared.written(_exchanged(keys).mapInArrow(_unpacked, "k long, h long, x long, lead_h long, lead_x long, more boolean"), "keys-shared")


def linked(keys: DataFrame, verified: Callable[[DataFrame], DataFrame], likely: Callable[[Column, Column], Column]) -> DataFrame:
    """(h, component) of the items that are linked with another; `verified` keeps the similar ones of pairs (a, b).

    Each key's lead is held against its other items, which is all for a key of two. In other keys, the items of one component are
    a cell: cells that are apart are held against each other by one item each, the lead if it is one of them, and then
    their other items against all that is still apart. No candidate between different components is left out but those that
    `likely` tells apart, given what keys carry of two items.
    """
    tried = keys.where("h <> lead_h").where(likely(F.col("lead_x"), F.col("x"))).select(F.least("lead_h", "h").alias("a"), F.greatest("lead_h", "h").alias("b"))
    tried = shared.written(tried.distinct(), "pairs-tried")
    comps = shared.written(shared.components(verified(tried)), "link-groups")
    led = F.max(F.col("h") == F.col("lead_h")).alias("led")
    items = keys.where("more").groupBy("k", "h").agg(F.first("x").alias("x"), F.min("lead_h").alias("lead"), led)
    items = shared.written(_placed(items, comps), "keys-placed")
    apart = items.groupBy("k").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("k")
    items = items.join(apart, "k", "left_semi")
    cells = items.groupBy("k", "c").agg(F.min(F.struct(~F.col("led"), "h", "x", "lead")).alias("i"), F.count("*").alias("n"))
    cells = shared.written(cells.select("k", "c", "i.h", "i.x", "i.lead", "n"), "cells-apart")
    pairs = _pairs(cells, cells, F.col("c_a") < F.col("c_b"), likely, tried)
    comps = _merged(comps, verified(pairs.select("a", "b")), pairs)
    if not cells.where("n > 1").isEmpty():
        one = cells.where("n > 1").select("k", "c", F.col("h").alias("one"))
        rest = items.join(one, ["k", "c"]).where("h <> one").select("k", "h").withColumn("rest", F.lit(True))
        items = items.join(rest.select("k").distinct(), "k", "left_semi").join(rest, ["k", "h"], "left").drop("c")
        items = shared.written(_placed(items, comps).withColumn("rest", F.col("rest").isNotNull()), "cells-apart")
        once = (F.col("c_a") != F.col("c_b")) & (~F.col("rest_b") | (F.col("h_a") < F.col("h_b")))
        pairs = _pairs(items.where("rest"), items, once, likely, tried.union(pairs.select("a", "b")))
        comps = _merged(comps, verified(pairs.select("a", "b")), pairs)
    return comps.withColumnRenamed("node", "h")


def _placed(items: DataFrame, comps: DataFrame) -> DataFrame:
    """items with their component c, which is an item's own h where it has none."""
    return items.join(comps.withColumnRenamed("node", "h"), "h", "left").withColumn("c", F.coalesce("component", "h")).drop("component")


def _pairs(one: DataFrame, other: DataFrame, apart: Column, likely: Callable[[Column, Column], Column], tried: DataFrame) -> DataFrame:
    """(a, b, c_a, c_b): likely pairs of items that share a key, are apart and have not been tried; each once, a < b."""
    side = lambda t, s: t.toDF(*[c if c == "k" else f"{c}_{s}" for c in t.columns])
    pairs = side(one, "a").join(side(other, "b"), "k").where(apart & (F.col("h_a") != F.col("lead_b")) & (F.col("h_b") != F.col("lead_a")))
    pairs = pairs.where(likely(F.col("x_a"), F.col("x_b"))).select(F.least("h_a", "h_b").alias("a"), F.greatest("h_a", "h_b").alias("b"), "c_a", "c_b")
    pairs = pairs.groupBy("a", "b").agg(F.min(F.least("c_a", "c_b")).alias("c_a"), F.max(F.greatest("c_a", "c_b")).alias("c_b"))
    return shared.written(pairs.join(tried, ["a", "b"], "left_anti"), "pairs-apart")


def _merged(comps: DataFrame, near: DataFrame, pairs: DataFrame) -> DataFrame:
    """comps (node, component) after the links `near` of pairs (a, b, c_a, c_b)."""
    if near.isEmpty():
        return comps
    links = near.join(pairs, ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))
    merged = shared.written(shared.components(links), "link-groups").toDF("component", "m")
    # Items that had no component yet stand for themselves.
    alone = merged.join(comps, merged["component"] == comps["node"], "left_anti").select(F.col("component").alias("node"), F.col("m").alias("component"))
    moved = comps.join(merged, "component", "left").select("node", F.coalesce("m", "component").alias("component"))
    return shared.written(moved.union(alone), "link-groups")
