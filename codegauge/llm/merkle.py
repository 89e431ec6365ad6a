"""Merkle manifest of a table: a tree of three children a node over each group's rows, and one over the groups' roots.

The nodes lie in a store, a Parquet table partitioned by level. Leaves are sorted by group and order into runs, which gives each its
place in its group; a node's place is its first child's, divided by three. HEIGHT levels at a time, the rows of a level stream in
order through tasks that hold one subtree of 3 ** HEIGHT nodes at most, and the levels above are written. Proofs are read
the same way: the store's rows of each subtree meet, in order of level and place, the proof of the subtree's own root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

ARITY, HEIGHT = 3, 7
#: The columns of a document that its leaf is made of, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "group string, pos long, n long, h string"


def leaf(*columns: Column) -> Column:
    """sha256 of the values one after another: `-` for null, else the number of UTF-8 bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (c.cast("string") for c in columns)]
    return F.sha2(F.concat(*parts), 256)


def folded(own: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its proof."""

    def up(h: Column, step: Column) -> Column:
        i = 64 * F.substring(step, 1, 1).cast("int")
        return F.sha2(F.concat(step.substr(F.lit(2), i), h, step.substr(i + 2, F.lit(64 * ARITY))), 256)

    return F.aggregate(steps, own, up)


def proof_digest(steps: Column) -> Column:
    """sha256 of all siblings of a proof, from the leaf up and from left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.substring(s, 2, 64 * ARITY)), ""), 256)


def _h(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def _above(below: list[str]) -> list[str]:
    return [_h(below[i : i + ARITY]) for i in range(0, len(below), ARITY)]


def _step(level: list[str], i: int) -> str:
    """The place of node i in its run, and the run's other nodes."""
    first = i - i % ARITY
    return f"{i - first}{''.join(level[first:i] + level[i + 1 : first + ARITY])}"


@dataclass(frozen=True)
class Forest:
    """The written trees of groups. leaves: group, pos, n (leaves of the group), h, extra; store: all levels above; roots: group, h, level."""

    leaves: DataFrame
    store: DataFrame | None
    levels: int
    roots: DataFrame
    height: int


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (group, h, extra and the columns of order) sorted into runs, with each row's place pos in its group and the group's size n.

    One range exchange; equal rows are told apart by where they lie, so that the exchange may split them. Places are
    numbered within a run, and the runs' counts, at most groups plus runs of them, are added up.
    """
    carried = [c for c in rows.columns if c not in order or c in ("group", "h")]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, i = None, -1
        for b in batches:
            places = []
            for g in b.column("group").to_pylist():
                last, i = g, i + 1 if g == last else 0
                places.append(i)
            yield b.append_column("i", pa.array(places, pa.int64()))

    rows = shared.written(rows, "leaves").withColumn("at", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("group", *order, "at").sortWithinPartitions("group", *order, "at").select(*carried, F.spark_partition_id().alias("run"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    runs = shared.written(rows.mapInArrow(number, f"{kinds}, i long"), "leaf-runs")
    counts = runs.groupBy("group", "run").agg(F.count("*").alias("c"))
    each = Window.partitionBy("group")
    counts = counts.select("group", "run", (F.sum("c").over(each.orderBy("run")) - F.col("c")).alias("before"), F.sum("c").over(each).alias("n"))
    ranked = runs.join(shared.written(counts, "run-counts"), ["group", "run"])
    return ranked.withColumn("pos", F.col("before") + F.col("i")).drop("run", "i", "before")


def _subtrees(key: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys; rows come in order, a run may lie in several batches."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        keys = list(zip(*(b.column(k).to_pylist() for k in key)))
        first = 0
        for i, k in enumerate(keys):
            if k != now:
                if first < i:
                    held.append(b.slice(first, i - first))
                if held:
                    yield pa.Table.from_batches(held)
                held, first, now = [], i, k
        if first < len(keys):
            held.append(b.slice(first))
    if held:
        yield pa.Table.from_batches(held)


def _grown(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(up, group, pos, n, h) of the nodes up to `height` levels above the given ones."""
    for t in _subtrees(["group", "chunk"], batches):
        group, pos, n, level = t["group"][0].as_py(), t["pos"][0].as_py(), t["n"][0].as_py(), t["h"].to_pylist()
        out: list[tuple] = []
        for up in range(1, height + 1):
            if n == 1:
                break
            level, pos, n = _above(level), pos // ARITY, -(-n // ARITY)
            out += [(up, group, pos + i, n, h) for i, h in enumerate(level)]
        up, group, pos, n, h = zip(*out)
        yield pa.record_batch([pa.array(up, pa.int32()), pa.array(group), pa.array(pos, pa.int64()), pa.array(n, pa.int64()), pa.array(h)], names=["up", "group", "pos", "n", "h"])


def _chunk(height: int, up: int | Column = 0) -> Column:
    """The subtree, 3 ** height nodes wide at its foot, in which a node so many levels above the foot lies."""
    return F.floor(F.col("pos") / F.pow(F.lit(float(ARITY)), F.lit(height) - up)).cast("long")


def forest(rows: DataFrame, order: list[str], height: int = HEIGHT) -> Forest:
    """The trees over rows (group, h, extra and the columns of order), group by group in the given order."""
    spark, path = rows.sparkSession, shared.place(rows.sparkSession, "merkle-store")
    leaves = shared.written(_ranked(rows, order), "merkle-leaves")
    below, base, roots = leaves.select("group", "pos", "n", "h"), 0, leaves.where("n = 1").select("group", "h", F.lit(0).alias("level"))
    while not (many := below.where("n > 1")).isEmpty():
        many = many.withColumn("chunk", _chunk(height)).repartition("group", "chunk").sortWithinPartitions("group", "chunk", "pos")
        grown = many.mapInArrow(partial(_grown, height), f"up int, {_NODES}").withColumn("level", F.col("up") + base)
        grown.drop("up").write.mode("append").option("compression", "zstd").partitionBy("level").parquet(path)
        base += height
        below = spark.read.schema(f"{_NODES}, level int").parquet(path).where(F.col("level") == base).drop("level")
    store = spark.read.schema(f"{_NODES}, level int").parquet(path) if base else None
    if store is not None:
        roots = roots.union(store.where("n = 1").select("group", "h", "level"))
    return Forest(leaves, store, base, roots, height)


def proofs(trees: Forest, tops: DataFrame) -> DataFrame:
    """(group, pos, h, extra, steps, subroot, root) of each leaf; tops: group, steps (those above the group's root), subroot, root.

    A step is a digit, the node's place in its run, and the digests of the run's other nodes.
    """
    height = trees.height
    tops = tops.join(trees.roots.select("group", "level"), "group").select("group", F.lit(0).cast("long").alias("pos"), "steps", "subroot", "root", "level")
    tops = shared.written(tops, "merkle-tops")
    kind = trees.leaves.schema["extra"].dataType.simpleString()
    above = tops.drop("level")
    for base in range(max(trees.levels - height, 0), -1, -height):
        nodes = trees.leaves.select("group", "pos", "n", "h", F.lit(0).alias("up"), "extra") if base == 0 else None
        if trees.store is not None:
            inner = trees.store.where(F.col("level").between(max(base, 1), base + height - 1)).where("n > 1")
            inner = inner.select("group", "pos", "n", "h", (F.col("level") - base).alias("up"), F.lit(None).cast(kind).alias("extra"))
            nodes = inner if nodes is None else nodes.union(inner)
        none = {"steps": "array<string>", "subroot": "string", "root": "string"}
        nodes = nodes.withColumn("chunk", _chunk(height, F.col("up"))).withColumns({c: F.lit(None).cast(k) for c, k in none.items()})
        heads = above.select("group", "pos", F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("h"), F.lit(height).alias("up"), F.lit(None).cast(kind).alias("extra"), F.col("pos").alias("chunk"), *none)
        merged = nodes.unionByName(heads).repartition("group", "chunk").sortWithinPartitions("group", "chunk", F.desc("up"), "pos")
        found = merged.mapInArrow(partial(_proved, height), f"group string, pos long, h string, extra {kind}, steps array<string>, subroot string, root string")
        if base:
            above = shared.written(found.select("group", "pos", "steps", "subroot", "root"), "merkle-proofs").union(tops.where(F.col("level") <= base).drop("level"))
    return found


def _proved(height: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["group", "pos", "h", "extra", "steps", "subroot", "root"]
    for t in _subtrees(["group", "chunk"], batches):
        up, h = t["up"].to_pylist(), t["h"].to_pylist()
        levels: list[list[str]] = [[] for _ in range(height)]
        for u, x in zip(up, h):
            if u < height:
                levels[u].append(x)
        if not levels[0]:
            continue  # a root below this subtree's foot
        ways = [t["steps"][0].as_py()]  # the proof of the subtree's root
        for level in reversed([x for x in levels if x]):
            if len(level) > ARITY * len(ways):
                raise ValueError("the store lacks a node")
            if t["n"][-1].as_py() > 1:  # a leaf alone is the root
                ways = [[_step(level, i), *ways[i // ARITY]] for i in range(len(level))]
        own = t.slice(len(up) - len(levels[0]))
        same = [pa.array([t[c][0].as_py()] * len(own), pa.string()) for c in ("subroot", "root")]
        columns = [*(own[c].combine_chunks() for c in names[:4]), pa.array(ways, pa.list_(pa.string())), *same]
        yield pa.record_batch([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names=names)


def manifest(leaves: DataFrame, height: int = HEIGHT) -> DataFrame:
    """leaves (source, doc_id, leaf, extra) with subroot, root and steps, the proof of each.

    The leaves of a source are in order of doc_id, null first, then of the leaf; sources in order of their bytes, null first. Repeated
    rows are leaves of their own. An empty table has no rows, and no root.
    """
    group = F.coalesce(F.concat(F.lit("="), "source"), F.lit(""))  # null is a group, and the first
    trees = forest(leaves.select(group.alias("group"), "doc_id", F.col("leaf").alias("h"), F.struct("doc_id", "extra").alias("extra")), ["doc_id", "h"], height)
    roots = trees.roots.select(F.lit("").alias("group"), "h", F.struct(F.col("group").alias("source")).alias("extra"), F.col("group").alias("name"))
    over = forest(roots, ["name"], height)
    root = over.roots.select("group", F.array().cast("array<string>").alias("steps"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    tops = proofs(over, root).select(F.col("extra.source").alias("group"), "steps", F.col("h").alias("subroot"), "root")
    found = proofs(trees, tops)
    source = F.when(F.col("group") != "", F.substring("group", 2, 1 << 30))
    return found.select(source.alias("source"), "extra.doc_id", F.col("h").alias("leaf"), "extra.extra", "subroot", "root", "steps")


def verified(docs: DataFrame, changed: Column, height: int = HEIGHT) -> DataFrame:
    """The manifest of docs, with each document's proof held against a leaf made from the text `changed`.

    Columns: doc_id, leaf, subroot, root, steps, proof_sha256, folded_root, verified. Null values, repeated ids and repeated rows are leaves
    like others; other columns of docs are left out of account, whatever their names. An empty table gives no rows.
    """
    names = {f: F.col(f) for f in FIELDS}
    claim = leaf(*(names | {"text": changed}).values())
    got = manifest(docs.select("source", "doc_id", leaf(*names.values()).alias("leaf"), claim.alias("extra")), height)
    got = got.withColumns({"proof_sha256": proof_digest(F.col("steps")), "folded_root": folded(F.col("extra"), F.col("steps"))})
    return got.select("doc_id", "leaf", "subroot", "root", "steps", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
