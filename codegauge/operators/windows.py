"""Ranking, order-dependent and sampling operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written


def kth_largest(values: list[Column], k: int) -> Column:
    """The k-th largest of a row's values."""
    return F.get(F.sort_array(F.array(*values), asc=False), F.lit(k - 1))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def occurrence(keys: list[str], order: list) -> Column:
    """1 for a key's first row, 2 for its second, and so on."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def before(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with the sum `name` of a group's values in the rows before each one; (group, order) tells rows apart.

    No task holds a group: rows are dealt to ranges of (group, order), which are written; sums of a range's rows are added
    up over ranges, a row for each range and group, and over rows inside each.
    """
    dealt = written(df.repartitionByRange(*group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    ranges = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    sums = written(sums.select(*group, "_range", F.coalesce(F.sum("_sum").over(ranges), F.lit(0)).alias("_below")), "range-sums")
    inside = Window.partitionBy(*group, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    kept = dealt.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0))).join(sums, [*group, "_range"])
    return kept.withColumn(name, F.col(name) + F.col("_below")).drop("_range", "_below")


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Distinct values of each group with count n and the mean rank of their rows.

    Rows are counted by value first, and counts are added up over ranges of values, so no task holds a group.
    """
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return before(counts, group, [value], "n", "rank").withColumn("rank", F.col("rank") + (F.col("n") + 1) / 2)


def benjamini_hochberg(df: DataFrame, p: str = "p", family: list[str] = ()) -> DataFrame:
    """Q-values over all p of a family at once; null p get null q. Families of tests are small."""
    whole = Window.partitionBy(*family)
    tested = df.where(F.col(p).isNotNull())
    rank = F.row_number().over(whole.orderBy(p))
    scaled = tested.withColumn("_k", rank).withColumn("_m", F.count("*").over(whole)).withColumn("_x", F.col(p) * F.col("_m") / F.col("_k"))
    q = F.least(F.lit(1.0), F.min("_x").over(whole.orderBy(p, "_k").rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    return scaled.withColumn("q", q).drop("_k", "_m", "_x").unionByName(df.where(F.col(p).isNull()).withColumn("q", F.lit(None).cast("double")))


def seeded_sample(df: DataFrame, key: str, n: int, seed: int, group: list[str] = ()) -> DataFrame:
    """N rows (of each group) without replacement, the same for the same seed: the first by hash of key and seed."""
    order = [F.xxhash64(F.col(key), F.lit(seed)), F.col(key)]
    if not group:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def fold(key: Column, folds: int, seed: int) -> Column:
    """A fold for each key, by hash; folds differ in size by chance only."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def in_order(df: DataFrame, column: str, order: tuple, *then: str) -> DataFrame:
    """Sorted by the column's position in a list, then by other columns."""
    return df.orderBy(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), *then)


def top_n(df: DataFrame, by: str, n: int, count: str = "n") -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.groupBy(by).agg(F.count("*").alias(count)).orderBy(F.desc(count), by).limit(n)


def first_by_priority(df: DataFrame, tiers: list[Column], *then) -> DataFrame:
    """One row: of the first tier that any row meets, the first in order."""
    tier = F.coalesce(*[F.when(t, F.lit(i)) for i, t in enumerate(tiers)])
    return df.withColumn("_t", tier).where("_t is not null").orderBy("_t", *then).limit(1).drop("_t")
