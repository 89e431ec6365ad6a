"""Analyzer findings: exclusion, categories, de-duplicated counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text


def excluded(symbols: Column, exact: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """Any of the comma-separated names is in the list or starts with a prefix."""
    def hit(s: Column) -> Column:
        out = s.isin(*exact)
        for p in prefixes:
            out = out | s.startswith(p)
        return out

    return F.exists(F.transform(F.split(symbols, ","), lambda s: F.trim(s)), hit)


def resolved(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Findings whose `rule` may be a comma-separated chain of aliases, with the first alias that has a category, and that as `odc`.

    categories (rule, odc); "--" and null are none. A finding without a category keeps its rule and gets "--".
    """
    chains = findings.select(F.col("rule").alias("chain")).distinct().select("chain", F.posexplode(F.split("chain", ",")).alias("place", "alias"))
    known = categories.select(F.trim(categories.columns[0]).alias("alias"), F.trim(categories.columns[1]).alias("odc")).where("odc <> '--'")
    first = chains.withColumn("alias", F.trim("alias")).join(known, "alias").groupBy("chain").agg(F.min(F.struct("place", "alias", "odc")).alias("first"))
    out = findings.drop("odc").join(first, findings["rule"] == first["chain"], "left").drop("chain")
    return out.withColumn("rule", F.coalesce("first.alias", "rule")).withColumn("odc", F.coalesce("first.odc", F.lit("--"))).drop("first")


def countable(language: Column, rule: Column, odc: Column) -> Column:
    """Whether a finding counts: its rule is not on its language's list and, in C, its category is not left out either.

    Another or a null language has no list. A null rule is on none.
    """
    out = F.when(language == "python", excluded(rule, schemas.PYLINT_EXCLUDED)).when(language == "java", excluded(rule, schemas.PMD_EXCLUDED))
    c = excluded(rule, schemas.CLANG_EXCLUDED, schemas.CLANG_EXCLUDED_PREFIXES)
    return ~F.coalesce(out.when(language == "c", F.coalesce(c, F.lit(False)) | F.coalesce(odc.isin(*schemas.CLANG_EXCLUDED_ODC), F.lit(False))), F.lit(False))


def defect_counts(keys: DataFrame, findings: DataFrame, key: list[str], categories: dict[str, str] = schemas.ODC_OF_LABEL, columns: tuple[str, ...] = schemas.ODC_COLUMNS) -> DataFrame:
    """A10: for each key the distinct (rule, odc, line) by category and in all; keys without findings get zeros.

    A category outside the map raises when its row is counted; "--" (no category) is left out.
    """
    distinct = findings.where("odc <> '--'").select(*key, "rule", "odc", "line").distinct()
    table = F.create_map(*[F.lit(x) for kv in categories.items() for x in kv])
    column = F.coalesce(F.try_element_at(table, F.col("odc")), F.raise_error(F.concat(F.lit("unknown category "), F.col("odc"))))
    counted = distinct.withColumn("c", column).groupBy(*key).agg(F.count("*").alias("defects_total"), *[F.count_if(F.col("c") == c).alias(c) for c in columns])
    return keys.select(*key).distinct().join(counted, key, "left").fillna(0, ["defects_total", *columns])


def vulnerability_counts(keys: DataFrame, results: DataFrame, key: list[str], failed: DataFrame | None = None, drop_on_error: bool = True) -> DataFrame:
    """Distinct (normalised CWEs, severity, trimmed lines) in all and of high severity, and the sorted CWEs.

    results (key, cwes, severity, lines); results without CWE do not count. With drop_on_error the findings of failed
    keys are discarded, as the live evaluator does; without, they stay, as the table builder does.
    """
    rows = results.where(F.size("cwes") > 0)
    if failed is not None and drop_on_error:
        rows = rows.join(failed.select(*key).distinct(), key, "left_anti")
    distinct = rows.select(*key, text.normalized_cwes(F.col("cwes")).alias("cwes"), F.upper("severity").alias("severity"), F.trim("lines").alias("lines")).distinct()
    counted = distinct.groupBy(*key).agg(F.count("*").alias("vulns_total"), F.count_if(F.col("severity").isin("CRITICAL", "ERROR")).alias("vulns_high_sev"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cwes")))).alias("cwes"))
    out = keys.select(*key).distinct().join(counted, key, "left").fillna(0, ["vulns_total", "vulns_high_sev"])
    return out.withColumn("cwes", F.coalesce("cwes", F.array().cast("array<string>")))


def study_report(findings: DataFrame, units: DataFrame, unit: str) -> DataFrame:
    """One row: findings, defective units, their share, and the mean of a defective unit."""
    per = findings.groupBy(unit).agg(F.count("*").alias("n"))
    total = units.agg(F.count("*").alias("units"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("defects"), F.count("*").alias("defective")).crossJoin(total).select("defects", "defective", F.try_divide("defective", "units").alias("share"), F.try_divide("defects", "defective").alias("mean_per_defective"))  # one row each


def defect_study(findings: DataFrame, category: str, rule: str, priority: str, top: int = 10) -> DataFrame:
    """(section, category, name, n, place): findings in all, by category, rule, rule within category and priority.

    One aggregation over all groupings; of rules, in all and within each category, the `top` most frequent are given (ties by name).
    Names are strings; null is a value of its own.
    """
    c, r, p = F.col(category), F.col(rule), F.col(priority)
    counted = findings.groupingSets([[], [c], [r], [c, r], [p]], c, r, p).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    g = F.col("g")
    section = F.when(g == 7, "total").when(g == 3, "category").when(g == 5, "rule").when(g == 1, "rule_in_category").otherwise("priority")
    name = F.when(g == 3, c.cast("string")).when(g.isin(5, 1), r.cast("string")).when(g == 6, p.cast("string"))
    rows = counted.select(section.alias("section"), F.when(g == 1, c.cast("string")).alias("category"), name.alias("name"), "n")
    place = F.row_number().over(Window.partitionBy("section", "category").orderBy(F.desc("n"), "name"))
    return rows.withColumn("place", place).where(~F.col("section").startswith("rule") | (F.col("place") <= top))


def categories_per_unit(findings: DataFrame, unit: str, category: str) -> DataFrame:
    """How many units have so many distinct categories."""
    return findings.groupBy(unit).agg(F.countDistinct(category).alias("categories")).groupBy("categories").agg(F.count("*").alias("units"))


def evidence(findings: Column, column: str) -> Column:
    """Findings of one category's column; those without a category pass."""
    labels = [k for k, v in schemas.ODC_OF_LABEL.items() if v == column]
    return F.filter(findings, lambda f: f["odc"].isNull() | f["odc"].isin(*labels))


def relevant_errors(errors: Column, registry: str = "https://semgrep.dev/") -> Column:
    """Errors that do not come from the rule registry."""
    return F.filter(errors, lambda e: ~e["path"].startswith(registry))
