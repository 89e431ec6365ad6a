"""Building the benchmark: hard tasks by consensus of models over a long metrics table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import contracts, gates, windows


def evidence(metrics: DataFrame, language: str, threshold: int) -> DataFrame:
    """§3.2, 2 to 6: one row for each key that may be hard enough, with who found what.

    An author is qualified if its complexity passes the gate against the human's; its burden is defects plus vulnerabilities.
    The score is the second largest burden of qualified models (-1 for the unqualified). One aggregation widens the table.
    """
    authors = schemas.AUTHORS[language]
    models = [a for a in authors if a != "human"]
    columns = ("nloc", "halstead_v", *schemas.OUTCOMES)
    w = gates.complete(gates.wide(metrics, "hm_index", authors, columns), [f"{c}__{a}" for c in columns for a in authors])
    v = lambda c, a: F.col(f"{c}__{a}")
    for a in models:
        r1, r2, ok = gates.complexity_gate(v("nloc", a), v("halstead_v", a), v("nloc", "human"), v("halstead_v", "human"))
        w = w.withColumn(f"r1__{a}", r1).withColumn(f"r2__{a}", r2).withColumn(f"ok__{a}", ok).withColumn(f"burden__{a}", v("defects_total", a) + v("vulns_total", a))
    w = w.withColumn("score", windows.kth_largest([F.when(v("ok", a), v("burden", a)).otherwise(F.lit(-1)) for a in models], 2))
    for a in models:
        w = w.withColumn(f"hard__{a}", v("ok", a) & (v("burden", a) >= threshold))
    agreed = [F.when(gates.count_true([v("hard", a) & (v(c, a) > 0) for a in models]) >= 2, F.lit(c)) for c in schemas.ODC_COLUMNS]
    w = w.withColumn("consensus_odc", F.filter(F.array(*agreed), lambda x: x.isNotNull()))
    w = w.withColumn("potential_cwe_consensus", gates.count_true([v("hard", a) & (v("vulns_total", a) > 0) for a in models]) >= 2)
    w = w.where((F.col("score") >= threshold) & ((F.size("consensus_odc") > 0) | F.col("potential_cwe_consensus")))

    def by_model(make) -> F.Column:
        return F.map_from_arrays(F.array(*[F.lit(a) for a in models]), F.array(*[make(a) for a in models]))

    odc = lambda a: text.nonzero(F.array(*[F.lit(c) for c in schemas.ODC_COLUMNS]), F.array(*[v(c, a) for c in schemas.ODC_COLUMNS]))
    difficulty = F.struct(
        F.col("score").cast("int").alias("score"), F.col("score").cast("int").alias("consensus_model_finding_burden"), by_model(lambda a: v("burden", a)).alias("model_issue_counts"),
        by_model(lambda a: v("ok", a)).alias("complexity_qualified_models"), by_model(lambda a: v("hard", a)).alias("difficulty_qualified_models"),
        by_model(lambda a: F.struct(v("r1", a).alias("nloc"), v("r2", a).alias("halstead_v"))).alias("complexity_ratios"),
        gates.count_true([v("ok", a) & (v("burden", a) > 0) for a in models]).alias("affected_models"), gates.count_true([v("ok", a) & (v("vulns_total", a) > 0) for a in models]).alias("vulnerable_models"),
        gates.count_true([v("ok", a) & (v("vulns_high_sev", a) > 0) for a in models]).alias("high_severity_models"), "consensus_odc", "potential_cwe_consensus",
        F.map_from_arrays(F.array(*[F.lit(a) for a in authors]), F.array(*[odc(a) for a in authors])).alias("odc_by_author"),
        v("defects_total", "human").alias("human_defects_total"), v("vulns_total", "human").alias("human_vulns_total"), F.struct(v("nloc", "human").alias("nloc"), v("halstead_v", "human").alias("halstead_v")).alias("human_complexity"),
    )
    return w.select("hm_index", difficulty.alias("difficulty"))


def consensus_cwes(found: DataFrame, raw: DataFrame) -> DataFrame:
    """(hm_index, consensus_cwes). Only findings (hm_index, author, cwe) of keys that may agree are read."""
    wanted = found.where("difficulty.potential_cwe_consensus").select("hm_index", F.explode(F.map_keys(F.map_filter("difficulty.difficulty_qualified_models", lambda _, ok: ok))).alias("author"))
    rows = raw.join(wanted, ["hm_index", "author"], "left_semi")
    return gates.consensus_values(rows, "hm_index", "author", "cwe").withColumnRenamed("values", "consensus_cwes")


def eligible(found: DataFrame, cwes: DataFrame) -> DataFrame:
    """§3.2, 8: keys with any consensus, and their stratum."""
    x = found.join(cwes, "hm_index", "left").withColumn("consensus_cwes", F.coalesce("consensus_cwes", F.array().cast("array<string>")))
    x = x.where((F.size("difficulty.consensus_odc") > 0) | (F.size("consensus_cwes") > 0))
    return x.withColumn("stratum", gates.stratum(F.col("consensus_cwes"), F.col("difficulty.consensus_odc")))


def tasks(dataset: DataFrame, chosen: DataFrame, language: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, counts of why rows were dropped). dataset (hm_index, docstring, signature, human_code, human_metrics, ordinal).

    First reason counts: no docstring or code, no signature, human code not strict, then a repeat of an earlier row.
    """
    x = dataset.join(chosen, "hm_index")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    why = gates.cascade([(blank("docstring") | blank("human_code"), "missing_prompt_or_human"), (F.col("signature").isNull(), "signature_or_parse_failure"), (~F.coalesce(F.col("human_metrics.strict_nontrivial"), F.lit(False)), "human_not_strict")])
    x = x.withColumn("why", why).withColumn("sha", text.content_hash(F.col("signature.text"), F.col("docstring"), F.col("human_code")))
    x = x.withColumn("copy", F.when(F.col("why").isNull(), windows.occurrence(["sha", "why"], ["ordinal"])))
    x = x.withColumn("why", F.when(F.col("copy") > 1, "exact_duplicate").otherwise(F.col("why")))
    kept = x.where("why is null").select(
        F.lit(schemas.BENCHMARK_VERSION).alias("benchmark_version"), text.task_id(F.lit(language), F.col("hm_index")).alias("task_id"), F.lit(language).alias("language"), F.col("hm_index").alias("source_id"),
        "stratum", "docstring", "signature", text.prompt(F.lit(language), F.col("docstring"), F.col("signature.text")).alias("prompt"), "difficulty", "consensus_cwes", "human_metrics", F.col("sha").alias("content_sha256"),
    )
    return kept, x.where("why is not null").groupBy("why").agg(F.count("*").alias("n"))


def benchmark(parts: list[DataFrame], least: int = schemas.MINIMUM_TASKS) -> DataFrame:
    """All languages in order; too few tasks raise."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    contracts.enforce(contracts.too_few(out, least), "too few tasks")
    return windows.in_order(out, "language", schemas.LANGUAGES, "task_id")


def metrics_table(complexity: DataFrame, defects: DataFrame, vulnerabilities: DataFrame, entropy: DataFrame) -> DataFrame:
    """The long metrics table. Rows without finite entropy go; defects and vulnerabilities must be there.

    complexity (hm_index, author, sample_nloc, function_count_computable, *_mean), entropy (hm_index, author, legacy: log10 per token).
    All parts are as long as the table, so none is broadcast, however small its files make it look.
    """
    from math import log2

    key = ["hm_index", "author"]
    defects, vulnerabilities, entropy = (part.hint("merge") for part in (defects, vulnerabilities, entropy))
    named = complexity.select(*key, "sample_nloc", "function_count_computable", *[F.col(k).cast("double").alias(n) for k, n in schemas.TABLE_NAME_OF.items()])
    finite = entropy.where(F.col("legacy").isNotNull() & ~F.isnan("legacy") & (F.abs("legacy") < float("inf"))).select(*key, (F.col("legacy") * log2(10)).alias("naturalness"))
    for part, name in ((defects, "defects"), (vulnerabilities, "vulnerabilities")):
        contracts.enforce(contracts.missing(named, part, key), f"no {name} for")
    rows = named.join(finite, key).join(defects.select(*key, "defects_total", *schemas.ODC_COLUMNS), key).join(vulnerabilities.select(*key, "vulns_total", "vulns_high_sev"), key)
    contracts.enforce(contracts.outside(rows, "hm_index", ("nloc", "ccn"), ("halstead_v", "mi")), "values out of range")
    contracts.enforce(contracts.broken_sums(rows, "hm_index", "defects_total", schemas.ODC_COLUMNS), "categories do not add up")
    contracts.enforce(contracts.broken_rules(rows, key, contracts.SEVERITIES), "counts do not fit")
    return rows.select([f.name for f in schemas.METRICS_LONG.fields])
