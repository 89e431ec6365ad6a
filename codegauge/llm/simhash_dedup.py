"""Near-duplicate documents by SimHash, with candidates from the pigeonring principle.

A 64-bit fingerprint is cut into m = d + 1 segments laid in a ring, d being the number of bits that may
differ. If two fingerprints differ in at most d bits, some segment starts a chain whose first l segments
differ in at most floor(l * d / m) bits together, for each l. For l = 1 that is none and for l = 2 at most
one, so both make a join key: (start, segment, next segment), the next one with at most one bit turned on
by the side that lacks it. The longer chains and the full distance are checked on the joined pairs.

Copies share a fingerprint and are one node, so a group of copies makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SHINGLE, SEED, DISTANCE = 3, 42, 2


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is 1 if more than half of the shingles' XXH64 have it. No words: 0. Fewer than `shingle`: one shingle."""
    import xxhash

    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[k:] for k in range(shingle)]))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(g, seed) for g in grams], "<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        part = h[k : k + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16 if len(part) < 65536 else np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle, seed) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])
        shared.release_memory()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def _segment(fp: Column, low: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b), a < b: the pairs of distinct fingerprints `fp` that differ in at most `distance` bits."""
    m = distance + 1
    cuts = [64 * k // m for k in range(m + 1)]
    low, width = cuts[:-1], [b - a for a, b in zip(cuts, cuts[1:])]
    if distance == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if max(width) > 32:
        m, low, width = 2, [0, 32], [32, 32]
    # One row for each start and, on the probing side, each bit that may be turned on in the next segment.
    starts = [(i, b) for i in range(m) for b in range(-1, width[(i + 1) % m])]
    pick = F.element_at
    seg = F.array(*[_segment(F.col("fp"), low[i], width[i]) for i in range(m)])
    nxt = F.array(*[_segment(F.col("fp"), low[(i + 1) % m], width[(i + 1) % m]) for i in range(m)])
    wide = F.array(*[F.lit(width[(i + 1) % m]) for i in range(m)])
    base = fps.select("fp", seg.alias("s"), nxt.alias("n"))

    def key(i: Column, second: Column) -> Column:
        return F.xxhash64(i, pick("s", i + 1), second) if max(width) > 30 else F.shiftleft(F.shiftleft(i.cast("long"), 30).bitwiseOR(pick("s", i + 1)), 30).bitwiseOR(second)

    index = base.select("fp", "s", "n", F.explode(F.array(*[F.lit(i) for i in range(m)])).alias("i"))
    index = index.select(F.col("fp").alias("b"), key(F.col("i"), pick("n", F.col("i") + 1)).alias("k"))
    probe = base.select("fp", "s", "n", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(b).alias("bit")) for i, b in starts])).alias("p"))
    probe = probe.select("fp", "s", "n", F.col("p.i").alias("i"), F.col("p.bit").alias("bit")).withColumn("x", pick("n", F.col("i") + 1))
    on = F.when(F.col("bit") >= 0, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long"))
    probe = probe.where((F.col("bit") < 0) | (F.col("x").bitwiseAND(on) == 0)).select(F.col("fp").alias("a"), key(F.col("i"), F.col("x").bitwiseOR(on)).alias("k"))
    # Both sides have several rows for each fingerprint, which the planner does not count: neither is broadcast.
    pairs = probe.join(index.hint("merge"), "k").where("a <> b").where(F.expr(f"bit_count(a ^ b) <= {int(distance)}"))
    chain = F.lit(False)  # some start keeps every prefix of its chain within the budget
    off = [F.expr(f"bit_count(shiftrightunsigned(a ^ b, {low[i]}) & {(1 << width[i]) - 1}L)") for i in range(m)]
    for i in range(m):
        ok, total = F.lit(True), F.lit(0)
        for n in range(1, m + 1):
            total = total + off[(i + n - 1) % m]
            ok = ok & (total <= n * distance // m)
        chain = chain | ok
    return pairs.where(chain).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def dedup_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """One row for each row of docs: doc_id, fp (long), component_id (least doc_id reachable), n_links.

    Only doc_id and text are read, so extra columns of any name do no harm. Null and empty texts have
    fingerprint 0 and link like any other. Rows that repeat, also with a repeated doc_id, each get a row. A
    null doc_id is never the least unless its whole group has none. An empty table gives no rows.
    """
    fps = shared.written(fingerprints(docs, shingle, seed), "fps")
    nodes = shared.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fp-nodes")
    pairs = shared.written(links(nodes.select("fp"), distance), "fp-links")
    # Written, so that both sides of the join have exchanges of their own and the rows of a frequent fingerprint may be split.
    comps = shared.written(components_of(nodes, pairs), "fp-names")
    return fps.join(comps.hint("merge"), "fp").select("doc_id", "fp", "component_id", "n_links")


def components_of(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, component_id, n_links) for each distinct fingerprint."""
    comps = shared.written(shared.components(pairs), "fp-components").select(F.col("node").alias("fp"), "component")
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    linked = nodes.join(comps, "fp")
    least = linked.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = comps.join(least, "component").join(degree, "fp").select("fp", "component_id", "n")
    return nodes.join(named, "fp", "left").select("fp", F.when(F.col("n").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """docs with one row of each group left, all columns as they were: a row with the group's least doc_id.

    Rows that share a doc_id are one document: of them one stays. A group in which every doc_id is null keeps
    one of its rows; other rows with a null doc_id go.
    """
    fps = shared.written(fingerprints(docs, shingle, seed), "fps")
    nodes = shared.written(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "fp-nodes")
    comps = components_of(nodes, shared.written(links(nodes.select("fp"), distance), "fp-links"))
    k_id, k_n = shared.fresh(docs, "keeper", "copy")
    kept = comps.where("component_id is not null").select(F.col("component_id").alias(k_id)).distinct()
    named = docs.join(kept.hint("merge"), docs["doc_id"] == F.col(k_id), "left_semi")
    named = named.withColumn(k_n, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), "text"))).where(F.col(k_n) == 1).drop(k_n)
    # Rows without an id are told apart by their fingerprints alone; most tables have none and skip this scan.
    one = F.pandas_udf(lambda t: t.map(lambda x: np.array(fingerprint(x, shingle, seed), np.uint64).view(np.int64)), "long")
    bare = comps.where("component_id is null").join(nodes, "fp").groupBy("component_id", "fp").count().select(F.col("fp").alias(k_id))
    bare = docs.where("doc_id is null").withColumn(k_n, one("text")).join(bare, F.col(k_n) == F.col(k_id), "left_semi").dropDuplicates([k_n]).drop(k_n)
    return named.unionByName(bare)
