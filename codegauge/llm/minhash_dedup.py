"""Near-duplicate documents by MinHash: many universal hash minima, banding, signature verification, connected components.

Documents with equal sets of shingles are one node, so a group of copies makes no pairs. A set's signature has BANDS * ROWS least values
of strongly universal hashes. Nodes that share a band's ROWS minima are candidates: a pair of similarity s is missed with probability
(1 - s ** ROWS) ** BANDS, at 0.85 less than one in two million. Candidates' signatures are verified: in a band's group, each node is tied to others
with which it agrees in about as many minima as similar sets do, as a spanning forest of at most as many ties as nodes. What is tied together is a
family; in a family's blocks the whole sets are compared, and again a spanning forest of the links is what comes out. So no
step gives more rows than there are nodes in its groups, and groups larger than LOT are dealt to several tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import minhash, shared

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.85, 25, 5
#: Nodes of a group that one task compares with each other, and shingles of a family's nodes that it holds for that.
LOT, HELD = 512, 1 << 20


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `shingle` words. Fewer words: one run. No words: none."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)])) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.array([xxhash.xxh64_intdigest(g, 42) for g in grams], np.uint64))


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Whether the Jaccard similarity of two sorted sets is at least so much."""
    if min(len(a), len(b)) < least * max(len(a), len(b)) - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both) - 1e-9


def minima(shingles: np.ndarray, n: int = BANDS * ROWS) -> np.ndarray:
    """The least of each of n hashes: the upper half of a * x + b modulo 2 ** 64, x being 32 bits of a shingle's hash."""
    rng = np.random.default_rng(11)
    a, b = rng.integers(0, 1 << 64, (2, n, 1), np.uint64)
    out = np.full(n, np.iinfo(np.uint64).max)
    for k in range(0, len(shingles), 512):  # stays in the processor's cache
        values = (shingles[k : k + 512] >> np.uint64(32)) * a
        values += b
        np.minimum(out, values.min(axis=1), out=out)
    return out >> np.uint64(32)


def _hash(data: bytes, seed: int) -> int:
    import xxhash

    return int(np.array(xxhash.xxh64_intdigest(data, seed), np.uint64).view(np.int64))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, at, n_shingles, h, g, keys, sketch) of each row. (h, g) stands for the set; without words all from h on is null.

    at tells rows of docs apart by id and text; keys has a band's minima as one long, the sketch a byte of each minimum.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for t in b.column(2):
                s = shingles(t.as_py(), shingle)
                if not len(s):
                    rows.append((0, None, None, None, None))
                    continue
                m = minima(s)
                keys = [_hash(m[k : k + ROWS].tobytes(), k) for k in range(0, len(m), ROWS)]
                rows.append((len(s), _hash(data := s.tobytes(), 1), _hash(data, 2), keys, m.astype(np.uint8).tobytes()))
            n, h, g, keys, sketch = zip(*rows)
            columns = [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())]
            yield pa.record_batch(columns, names=["doc_id", "at", "n_shingles", "h", "g", "keys", "sketch"])
        shared.release_memory()

    return docs.select("doc_id", _at().alias("at"), "text").mapInArrow(run, f"doc_id {kind}, at long, n_shingles long, h long, g long, keys array<long>, sketch binary")


def _at() -> Column:
    return F.xxhash64("doc_id", "text")


def _agreeing(rows: list[dict]) -> np.ndarray:
    """In how many minima each two rows' signatures agree, by one byte of each."""
    sketch = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), -1)
    if len(rows) <= 16:
        return (sketch[:, None] == sketch).sum(axis=2)
    same = np.zeros((len(rows), len(rows)), np.int64)
    for k in range(sketch.shape[1]):
        same += sketch[:, k, None] == sketch[:, k]
    return same


def _least_agreeing(similarity: float) -> int:
    """Minima in which sets so similar agree but once in a thousand million: six and a half deviations below their mean."""
    n = BANDS * ROWS
    return math.floor(n * similarity - 6.5 * math.sqrt(n * similarity * (1 - similarity)))


def _forest(rows: list[dict], item: str, least: int, linked: Callable[[int, int], bool] | None = None) -> list[tuple]:
    """Links between the rows of a block that agree in so many minima, best first, without those inside what is linked already."""
    same = _agreeing(rows)
    return [(rows[x][item], rows[y][item]) for x, y in minhash.forest(minhash.met(rows) & (same >= least), -same, linked)]


def families(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(h, family) of nodes (h, g, keys, sketch) that share a band with another and agree with some node of their family in their signatures."""
    least = _least_agreeing(similarity)
    keyed = nodes.select("h", F.posexplode("keys").alias("band", "k"))
    shares = keyed.groupBy("band", "k").agg(F.count("*").alias("n"), F.min("h").alias("low")).where("n > 1")
    shares = shared.written(shares, "band-groups")
    # A larger group is one family without a look at the signatures: a star to its least node, and its blocks are those of the family.
    members = shared.written(keyed.join(shares, ["band", "k"]), "band-members")
    few = members.where(F.col("n") <= LOT)
    few = few.join(nodes.select("h", "sketch"), "h").withColumn("key", F.struct("band", "k"))
    ties = minhash.in_blocks(few, "key", "h", F.lit(1), lambda rows: _forest(rows, "h", least), "long", ["sketch"])
    ties = ties.union(members.where(F.col("n") > LOT).select(F.col("low").alias("a"), F.col("h").alias("b")))
    found = shared.written(shared.components(shared.written(ties.distinct(), "signature-ties")), "families").toDF("h", "family")
    shared.drop_written(shares, members)
    return found


def links(docs: DataFrame, nodes: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) of nodes, as binary ids: a spanning forest of all pairs of sets that are similar."""
    groups, least = families(nodes, similarity), _least_agreeing(similarity)
    sizes = groups.join(nodes.select("h", F.col("n_shingles").alias("n")), "h").groupBy("family").agg(F.ceil(F.greatest(F.count("*") / LOT, F.sum("n") / HELD)).alias("lots"))
    wanted = nodes.select("h", "g", "at", "sketch").join(groups.join(sizes, "family"), "h")
    texts = docs.select(_at().alias("at"), "text").join(shared.written(wanted, "family-members"), "at")
    members = texts.select("family", "lots", F.struct("h", "g").alias("node"), "sketch", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()  # rows that repeat have one id and text
        for b in batches:
            nodes = [(x["h"], x["g"]) for x in b.column(2).to_pylist()]
            new = [n not in seen and not seen.add(n) for n in nodes]
            part = b.filter(pa.array(new, pa.bool_()))
            ids = [np.array(n, ">i8").tobytes() for n, first in zip(nodes, new) if first]
            data = [shingles(t.as_py(), shingle).tobytes() for t in part.column(4)]
            yield pa.record_batch([part.column(0), part.column(1), pa.array(ids, pa.binary()), part.column(3), pa.array(data, pa.binary())], names=["family", "lots", "node", "sketch", "s"])
        shared.release_memory()

    def forest(rows: list[dict]) -> list[tuple]:
        rows = list({r["node"]: r for r in rows}.values())
        data = [np.frombuffer(r["s"], np.uint64) for r in rows]
        return _forest(rows, "node", least, lambda x, y: similar(data[x], data[y], similarity))

    members = members.mapInArrow(sets, "family long, lots long, node binary, sketch binary, s binary")
    return shared.written(minhash.in_blocks(members, "family", "node", F.col("lots"), forest, "binary", ["sketch", "s"]), "minhash-links")


def dedup_groups(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (least doc_id reachable), kept (doc_id = component_id).

    Only doc_id and text are read, so extra columns of any name do no harm. Texts without words are linked with nothing, each other
    included. Repeated rows and repeated ids each get a row. A null doc_id is never the least unless its whole group has
    none; then component_id is null, and its rows are kept. An empty table gives no rows.
    """
    rows, named = named_sets(docs, shingle, similarity)
    found = rows.select("doc_id", "n_shingles", "h", "g").join(named.drop("one").hint("merge"), ["h", "g"], "left")
    found = found.withColumn("component_id", F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def named_sets(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(signatures of docs, their sets): of each set (h, g) the least doc_id of its component, and `one`, the least `at` there."""
    rows = shared.written(signatures(docs, shingle), "minhash-signatures")
    nodes = rows.where("h is not null").groupBy("h", "g").agg(F.min("doc_id").alias("least_id"), F.min("at").alias("at"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = shared.written(nodes, "minhash-nodes")
    comps = shared.components(links(docs, nodes, shingle, similarity))
    part = lambda k: F.conv(F.hex(F.substring("node", k, 8)), 16, -10).cast("long")
    comps = shared.written(comps.select(part(1).alias("h"), part(9).alias("g"), "component"), "minhash-components")
    linked = shared.written(nodes.select("h", "g", "least_id", "at").join(comps, ["h", "g"]), "minhash-linked")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"), F.min("at").alias("one"))
    alone = nodes.join(comps, ["h", "g"], "left_anti").select("h", "g", F.col("least_id").alias("component_id"), F.col("at").alias("one"))
    # Written, so that the join of rows with it may be split where one set has a great many of them.
    named = shared.written(linked.join(least, "component").select("h", "g", "component_id", "one").union(alone), "minhash-names")
    shared.drop_written(nodes, comps, linked)
    return rows, named


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies left, all columns as they were: a row with the group's least doc_id.

    Texts without words are one group. Rows that share a doc_id are one document: of them one stays. A group in which every doc_id is
    null keeps one of its rows; other rows with a null doc_id go.
    """
    rows, named = named_sets(docs, shingle, similarity)
    empty = rows.where("h is null").agg(F.min("doc_id").alias("component_id"), F.min("at").alias("one")).where("one is not null")
    groups = shared.written(named.select("component_id", "one").union(empty), "near-groups")
    shared.drop_written(rows, named)
    k_id, k_n = shared.fresh(docs, "keeper", "copy")
    kept = groups.where("component_id is not null").select(F.col("component_id").alias(k_id)).distinct()
    alike = docs.join(kept.hint("merge"), docs["doc_id"] == F.col(k_id), "left_semi")
    alike = alike.withColumn(k_n, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where(F.col(k_n) == 1).drop(k_n)
    bare = groups.where("component_id is null").select(F.col("one").alias(k_id)).distinct()
    bare = docs.where("doc_id is null").withColumn(k_n, _at()).join(bare, F.col(k_n) == F.col(k_id), "left_semi").dropDuplicates([k_n]).drop(k_n)
    return alike.unionByName(bare)
