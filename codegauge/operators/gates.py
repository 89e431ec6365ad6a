"""Gates, consensus and summaries over metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is missing or not positive."""
    return F.when(b > 0, a.cast("double") / b)


def complexity_gate(nloc: Column, halstead: Column, human_nloc: Column, human_halstead: Column, least: float = schemas.COMPLEXITY_RATIO) -> tuple[Column, Column, Column]:
    """(nloc ratio, volume ratio, passes). Without human figures it passes; a figure missing or not positive fails."""
    no_human = human_nloc.isNull() & human_halstead.isNull()
    sound = F.coalesce((nloc > 0) & (halstead > 0) & (human_nloc > 0) & (human_halstead > 0), F.lit(False))
    r1, r2 = F.when(sound, nloc / human_nloc), F.when(sound, halstead / human_halstead)
    return r1, r2, F.when(no_human, True).when(~sound, False).otherwise((r1 >= least) | (r2 >= least))


def undersized(statements: Column, token_ratio: Column, ast_ratio: Column) -> Column:
    """P5: few statements and both ratios small; a null ratio is not small."""
    small = (token_ratio < schemas.UNDERSIZED_RATIO) & (ast_ratio < schemas.UNDERSIZED_RATIO)
    return F.coalesce((statements <= schemas.UNDERSIZED_STATEMENTS) & small, F.lit(False))


def cascade(cases: list[tuple[Column, object]], otherwise=None) -> Column:
    """The first case that holds."""
    out = None
    for condition, value in cases:
        v = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, v) if out is None else out.when(condition, v)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def status(parseable: Column, present: Column, arity: Column, stub: Column, constant: Column, small: Column) -> Column:
    """The structural status."""
    return cascade([(~parseable, "parse_error"), (~present, "target_missing"), (~arity, "arity_mismatch"), (stub, "explicit_stub"), (constant, "constant_noop"), (small, "undersized")], "nontrivial")


def stratum(cwes: Column, odc: Column) -> Column:
    """From the consensus lists."""
    return cascade([((F.size(cwes) > 0) & (F.size(odc) > 0), "mixed_consensus"), (F.size(cwes) > 0, "vulnerability_consensus")], "defect_consensus")


def wide(long: DataFrame, key: str, authors: tuple[str, ...], columns: tuple[str, ...]) -> DataFrame:
    """One row a key, columns column__author; one aggregation, no pivot job."""
    cells = [F.first(F.when(F.col("author") == a, F.col(c)), ignorenulls=True).alias(f"{c}__{a}") for c in columns for a in authors]
    return long.where(F.col("author").isin(*authors)).groupBy(key).agg(*cells)


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with all of the columns present and not NaN."""
    return df.dropna(subset=columns)


def count_true(flags: list[Column]) -> Column:
    """How many hold; null counts as no."""
    return sum((F.coalesce(f, F.lit(False)).cast("int") for f in flags), F.lit(0))


def consensus_values(rows: DataFrame, key: str, author: str, value: str, least: int = 2) -> DataFrame:
    """(key, values): values that at least so many authors have, sorted."""
    votes = rows.select(key, author, value).distinct().groupBy(key, value).agg(F.count("*").alias("votes"))
    return votes.where(F.col("votes") >= least).groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


# Rates of the report (M1): each is a Column that is null only where it must not count.
def _zero(c: str) -> Column:
    return F.coalesce(F.col(c) == 0, F.lit(False))


RATES = {
    "submitted_rate": lambda: F.col("submitted"),
    "parseable_rate": lambda: F.col("parseable"),
    "target_present_rate": lambda: F.col("target_present"),
    "nonstub_rate": lambda: F.col("nonstub"),
    "strict_nontrivial_rate": lambda: F.col("strict_nontrivial"),
    "defect_free_rate": lambda: _zero("defects_total"),
    "vulnerability_free_rate": lambda: _zero("vulns_total"),
    "high_severity_free_rate": lambda: _zero("vulns_high_sev"),
    "clean_nonstub_at_1": lambda: F.col("nonstub") & _zero("defects_total") & _zero("vulns_total"),
    "clean_strict_at_1": lambda: F.col("strict_nontrivial") & _zero("defects_total") & _zero("vulns_total"),
}


def rate(flag: Column) -> Column:
    """A1, A3: the share of rows for which it holds."""
    return F.avg(flag.cast("double"))


def incidence(count: Column, scanned: Column) -> Column:
    """A2: the share of rows with any, only if every row was scanned."""
    return F.when(F.count(scanned) == F.count(F.lit(1)), F.avg((count > 0).cast("double")))


def five_way(column: str) -> list[Column]:
    """Sum, mean, median, min and max of a column."""
    c = F.col(column)
    return [F.sum(c).alias(f"{column}_sum"), F.avg(c).alias(f"{column}_mean"), F.median(c).alias(f"{column}_median"), F.min(c).alias(f"{column}_min"), F.max(c).alias(f"{column}_max")]


def distribution(column: str) -> list[Column]:
    """Count, mean, least, median, 90th percentile, greatest, sample deviation."""
    c = F.col(column)
    return [F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("least"), F.percentile(c, F.lit(0.5)).alias("median"), F.percentile(c, F.lit(0.9)).alias("p90"), F.max(c).alias("greatest"), F.stddev_samp(c).alias("deviation")]


def accounting(detected: Column) -> list[Column]:
    """Of samples with so many functions (null: none): seen, empty, with several, with one, and functions in all."""
    n = F.coalesce(detected, F.lit(0))
    return [F.count(F.lit(1)).alias("seen"), F.count_if(n == 0).alias("empty"), F.count_if(n > 1).alias("multiple"), F.count_if(n == 1).alias("single"), F.sum(n).cast("long").alias("detected")]


def degenerate(nloc: Column, operators: Column, operands: Column) -> Column:
    """Functions that the older per-function analysis leaves out: no lines, no operators or no operands; what is missing counts as none."""
    none = lambda c: F.coalesce(c, F.lit(0)) <= 0
    return none(nloc) | none(operators) | none(operands)


def mean_if(value: Column, flag: Column) -> Column:
    """The mean over rows for which the flag holds; null where there is none."""
    return F.avg(F.when(flag, value))


def members(arrays: Column) -> tuple[Column, Column]:
    """A5: (mean, number) of all members of a group's arrays, from each array's sum and size: nothing is exploded. A null array has none."""
    total = F.sum(F.aggregate(arrays, F.lit(0.0), lambda a, x: a + x.cast("double")))
    count = F.coalesce(F.sum(F.when(arrays.isNotNull(), F.size(arrays).cast("long"))), F.lit(0))
    return F.try_divide(total, count), count


def value_counts(value: Column) -> dict[str, Column]:
    """How many values are null, zero, and neither null nor finite."""
    return {"nulls": F.count_if(value.isNull()), "zeros": F.count_if(value == 0), "odd": F.count_if(F.isnan(value) | (F.abs(value) == float("inf")))}
