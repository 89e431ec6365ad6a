"""Sets of keys and sets in rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sides(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, in_left, in_right) of each key that a side has; null is a key like others. One aggregation over both sides."""
    both = left.select(*keys, F.lit(True).alias("l")).unionByName(right.select(*keys, F.lit(False).alias("l")))
    return both.groupBy(*keys).agg(F.bool_or("l").alias("in_left"), F.bool_or(~F.col("l")).alias("in_right"))


def intersection(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """T4."""
    return sides(left, right, keys).where("in_left and in_right").select(*keys)


def not_covered(expected: DataFrame, parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """T5: expected keys that the union of the parts lacks."""
    union = parts[0].select(*keys)
    for p in parts[1:]:
        union = union.unionByName(p.select(*keys))
    return sides(expected, union, keys).where("in_left and not in_right").select(*keys)


def sizes(left: DataFrame, right: DataFrame, keys: list[str], wanted: dict[str, str]) -> DataFrame:
    """T1 to T5 as counts: (name, n) for each wanted name of both, either, left (only) or right (only)."""
    a, b = F.col("in_left"), F.col("in_right")
    tests = {"both": a & b, "either": a | b, "left": a & ~b, "right": b & ~a}
    row = sides(left, right, keys).agg(*[F.count_if(tests[kind]).alias(name) for name, kind in wanted.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("n")) for n in wanted])).alias("x")).select("x.*")


def merged(values: Column) -> Column:
    """T7, as an aggregate: the sorted distinct members of a group's arrays; arrays are made distinct before they are gathered."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.array_sort(F.array_distinct(values))))))


def distinct_sorted(value: Column) -> Column:
    """A12, as an aggregate: a group's distinct values, sorted."""
    return F.array_sort(F.collect_set(value))
