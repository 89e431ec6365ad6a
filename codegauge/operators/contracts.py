"""Contracts: each gives the rows that violate it; `enforce` raises with a few of them.

A contract is a DataFrame, so it runs distributed and only its first examples come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    pass


def enforce(violations: DataFrame, message: str, examples: int = 10) -> None:
    """C*: raises if there is any violation, with the first examples in order."""
    bad = violations.orderBy(*violations.columns).limit(examples).collect()
    if bad:
        raise ContractError(f"{message}: " + "; ".join(", ".join(str(v) for v in r) for r in bad))


def bad_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that are null, blank or repeated."""
    k = F.col(key)
    return df.groupBy(k.alias(key)).agg(F.count("*").alias("n")).where(k.isNull() | (F.trim(k.cast("string")) == "") | (F.col("n") > 1))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(*keys).distinct().join(right.select(*keys), keys, "left_anti")


def unequal_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one side has, with the side."""
    return missing(left, right, keys).withColumn("only_in", F.lit("left")).union(missing(right, left, keys).withColumn("only_in", F.lit("right")))


def uncovered(rows: DataFrame, keys: DataFrame, authors: list[str]) -> DataFrame:
    """C4: (key, author) pairs that rows lack; keys has one column. The author list is short and becomes an array."""
    key = keys.columns[0]
    wanted = keys.select(key, F.explode(F.array(*[F.lit(a) for a in authors])).alias("author"))
    return missing(wanted, rows, [key, "author"])


def outside(df: DataFrame, key: str, positive: tuple[str, ...] = (), nonnegative: tuple[str, ...] = ()) -> DataFrame:
    """(key, column, value) that is null, not finite, negative, or zero where it must be positive."""
    cols = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value"), F.lit(c in positive).alias("above")) for c in (*positive, *nonnegative)]
    x = df.select(F.col(key), F.explode(F.array(*cols)).alias("x")).select(key, "x.*")
    v = F.col("value")
    return x.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")) | (v < 0) | (F.col("above") & (v == 0))).select(key, "column", "value")


def broken_sums(df: DataFrame, key: str, total: str, parts: tuple[str, ...]) -> DataFrame:
    """Rows whose total is not the sum of its parts."""
    return df.where(~F.col(total).eqNullSafe(sum((F.col(p) for p in parts), F.lit(0)))).select(key, total)


#: What must hold between a row's counts.
FUNCTION_COUNTS = {
    "computable functions are among the detected": "0 <= function_count_computable and function_count_computable <= function_count_detected",
    "dropped functions are the other detected ones": "function_count_dropped = function_count_detected - function_count_computable",
}
SEVERITIES = {"findings of high severity are among all": "0 <= vulns_high_sev and vulns_high_sev <= vulns_total"}


def broken_rules(df: DataFrame, key: list[str], rules: dict[str, str]) -> DataFrame:
    """(key, rule) for each rule, an SQL condition by name, that does not hold in a row; null does not hold. One pass for all rules."""
    broken = F.array(*[F.when(~F.coalesce(F.expr(condition), F.lit(False)), F.lit(name)) for name, condition in rules.items()])
    return df.select(*key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def stale_mapping(findings: DataFrame, current: DataFrame) -> DataFrame:
    """(rule, odc) stored with findings that the current map (rule, odc) gives another category."""
    now = current.select("rule", F.col("odc").alias("now"))
    return findings.select("rule", "odc").distinct().join(now, "rule", "left").where(~F.col("odc").eqNullSafe(F.coalesce("now", F.lit("--"))))


def unknown_values(df: DataFrame, column: str, domain: tuple) -> DataFrame:
    """Values outside the domain."""
    return df.where(~F.col(column).isin(*domain) | F.col(column).isNull()).select(column).distinct()


def too_few(df: DataFrame, least: int) -> DataFrame:
    """One row if df has fewer rows."""
    return df.agg(F.count("*").alias("rows")).where(F.col("rows") < least)


def foreign(df: DataFrame, column: str, expected: Column) -> DataFrame:
    """Values of the column other than the expected one."""
    return df.where(~F.col(column).eqNullSafe(expected)).select(column).distinct()


def conserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row if the row counts differ."""
    counts = before.agg(F.count("*").alias("rows_in")).crossJoin(after.agg(F.count("*").alias("rows_out")))  # one row each
    return counts.where("rows_in <> rows_out")
