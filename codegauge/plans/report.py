"""Paired comparison of result sets and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import gates, joins, stats, windows
from ..sources import sinks

#: Metrics that need analyzer outcomes; they are left out where any submission row has none.
_OUTCOME_METRICS = tuple(n for n in gates.RATES if n.startswith(("defect_", "vulnerability_", "high_", "clean_")))


def compare(submission: DataFrame, baselines: dict[str, DataFrame], resamples: int = schemas.BOOTSTRAP_RESAMPLES) -> DataFrame:
    """One row for each baseline, language and metric."""
    columns = ["submitted", "parseable", "target_present", "nonstub", "strict_nontrivial", "defects_total", "vulns_total", "vulns_high_sev"]

    def rates(df: DataFrame) -> DataFrame:
        return df.select("task_id", "language", *columns).select("task_id", "language", F.col("defects_total").isNull().alias("unscanned"), *[r().cast("double").alias(n) for n, r in gates.RATES.items()])

    mine, out = rates(submission), None
    for name, rows in baselines.items():
        both = joins.paired(mine, rates(rows), ["task_id", "language"])
        cells = F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"{n}_a").alias("a"), F.col(f"{n}_b").alias("b"), F.lit(n in _OUTCOME_METRICS).alias("outcome")) for n in gates.RATES])).alias("x")
        long = both.select("language", "unscanned_a", cells).select(F.lit(name).alias("baseline"), "language", "x.*", "unscanned_a")
        scanned = both.groupBy("language").agg(F.max("unscanned_a").alias("some_unscanned"))
        long = long.join(scanned, "language").where(~(F.col("outcome") & F.col("some_unscanned"))).select("baseline", "language", "metric", "a", "b")
        out = long if out is None else out.unionByName(long)
    return stats.paired_deltas(out, ["baseline", "language", "metric"], resamples)


def odc_table(results: DataFrame) -> DataFrame:
    """Incidence of each category by language, one row a category, one column a language."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("odc"), (F.col(c) > 0).cast("double").alias("hit")) for c in schemas.ODC_COLUMNS])).alias("x")
    long = results.select("language", cells).select("language", "x.*")
    return long.groupBy("odc").agg(*[F.avg(F.when(F.col("language") == g, F.col("hit"))).alias(g) for g in schemas.LANGUAGES])


def distributions(results: DataFrame, metrics: tuple[str, ...] = schemas.OUTCOMES) -> DataFrame:
    """Incidence of each metric by scope (ALL or a language) and author; the total comes from the same pass."""
    sets = scopes(results, "language", ["author"], {m: F.avg((F.col(m) > 0).cast("double")) for m in metrics})
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("incidence")) for m in metrics])).alias("x")
    return sets.select("scope", "author", cells).select("scope", "author", "x.*")


def scopes(rows: DataFrame, scope: str, by: list[str], values: dict[str, Column]) -> DataFrame:
    """(scope, by, values): aggregates over all rows of each `by` (scope ALL) and over those of each scope; one pass."""
    keys = [F.col(c) for c in by]
    sets = rows.groupingSets([keys, [F.col(scope), *keys]], F.col(scope), *keys).agg(*[v.alias(n) for n, v in values.items()], F.grouping(scope).alias("_all"))
    return sets.select(F.when(F.col("_all") == 1, "ALL").otherwise(F.col(scope)).alias("scope"), *by, *values)


def cwe_distribution(results: DataFrame) -> DataFrame:
    """How many tasks name each CWE, by scope and author."""
    each = results.select("language", "author", F.explode("cwes").alias("cwe"))
    sets = each.groupingSets([[F.col("author"), F.col("cwe")], [F.col("language"), F.col("author"), F.col("cwe")]], F.col("language"), F.col("author"), F.col("cwe")).agg(F.count("*").alias("count"), F.grouping("language").alias("g"))
    return sets.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("language")).alias("scope"), "author", "cwe", "count")


def security_report(findings: DataFrame, unit: str, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, the most frequent (cwe, severity))."""
    totals = findings.agg(F.countDistinct(unit).alias("vulnerable"), F.count("*").alias("issues"), F.countDistinct("cwe").alias("cwes"))
    return totals, findings.groupBy("cwe", "severity").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cwe", "severity").limit(most)


def worked_example(table: DataFrame, author: str = "human", *order: str) -> dict | None:
    """The first of an author's rows with defects and vulnerabilities, else with either, else the first; null if it has none."""
    some, more = F.col("defects_total") > 0, F.col("vulns_total") > 0
    row = windows.first_by_priority(table.where(F.col("author") == author), [some & more, some | more, F.lit(True)], *(order or ("hm_index",))).first()
    return None if row is None else row.asDict(recursive=True)


def validated_table(table: DataFrame, path: str, language: str, dataset_rows: int, overwrite: bool = False) -> dict:
    """Writes the metrics table and returns its validation report: by author rows, nulls of predictors and zeros of outcomes.

    Nulls and zeros are counted while the table is written. The worked example is read from what was written.
    """
    authors, predictors = schemas.AUTHORS[language], tuple(f.name for f in schemas.METRICS_LONG.fields if f.name not in ("hm_index", "author", *schemas.OUTCOMES, *schemas.ODC_COLUMNS))
    profile = sinks.write_profiled(table, path, "author", authors, predictors, tuple(schemas.OUTCOMES), overwrite)
    by: dict = {}
    for author, column, rows, nulls, zeros in profile:
        a = by.setdefault(author, {"sample_rows": rows, "samples_missing": dataset_rows - rows, "predictor_nulls": {}, "outcome_zero_counts": {}})
        if nulls is not None:
            a["predictor_nulls"][column] = nulls
        if zeros is not None:
            a["outcome_zero_counts"][column] = zeros
    if "other" in by:
        raise ValueError("rows of other authors")
    return {"language": language, "dataset_rows": dataset_rows, "authors": by, "worked_example": worked_example(table.sparkSession.read.parquet(path))}
