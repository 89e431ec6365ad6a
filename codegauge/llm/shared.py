"""What the operators of this subpackage share: written tables, free column names, components."""

from __future__ import annotations

import ctypes

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import drop_written, place, shared_folder, written  # noqa: F401

#: A word: a run of bytes other than space and \t \n \v \f \r. bytes.split() cuts at just these.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while (n := f"_{n}") in have:
            pass
        have.add(n)
        out.append(n)
    return out


def id_text(c: Column) -> Column:
    return c.cast("string")


def release_memory() -> None:
    """Called at the end of a Python task: workers are kept for later tasks, and should not keep this one's memory."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def _stars(e: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (u > v).

    The least neighbours are written before they are joined: both sides of the join then have exchanges of their own, and the
    planner may split the rows of a hub with a great many neighbours.
    """
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = written(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "edges-least")
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
    large = written(large, "edges-large")
    low = written(large.groupBy("u").agg(F.min("v").alias("m")), "edges-least")
    small = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = written(small.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
    drop_written(least, large, low)
    return out


def _settled(e: DataFrame) -> bool:
    """Whether each node has one edge to its component's least node, or is such a least node."""
    sides = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("low")).union(e.select("v", F.lit(0), F.lit(1)))
    return sides.groupBy("n").agg(F.sum("up").alias("up"), F.max("low").alias("low")).where("up + low > 1").isEmpty()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of an undirected graph given as edges (a, b); component is the least node reachable.

    Large-star / small-star rounds over DataFrames: each halves distances to the least node, and each is
    written to the shared folder. No edge comes to the driver. Self-loops and nulls make no edge; a
    node without edges has no row. Raises if the rounds do not suffice.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u is not null and v is not null and u > v").distinct()
    e = written(e, "edges")
    for _ in range(rounds):
        if _settled(e):
            break
        old, e = e, _stars(e)
        drop_written(old)
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
