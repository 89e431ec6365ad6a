"""Evaluation of submitted code: tasks, references and predictions to one result a task, and their summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions import scan, text
from ..operators import contracts, findings, gates, joins
from ..sources.store import spread



def validate(tasks: DataFrame, predictions: DataFrame) -> None:
    """Known, unique task ids and code that is there."""
    contracts.enforce(contracts.bad_keys(tasks, "task_id"), "task_id in tasks")
    contracts.enforce(contracts.bad_keys(predictions, "task_id"), "task_id in predictions")
    contracts.enforce(contracts.missing(predictions, tasks, ["task_id"]), "unknown task_id")
    contracts.enforce(predictions.where("code is null").select("task_id"), "no code")


def function_aggregate(functions: Column) -> list[Column]:
    """Counts and five-way summaries over the computable functions, from the array itself: no explode, no shuffle."""
    fine = F.filter(functions, lambda f: f["drop_reason"].isNull())
    out = [
        F.size(functions).cast("long").alias("function_count_detected"), F.size(fine).cast("long").alias("function_count_computable"),
        (F.size(functions) - F.size(fine)).cast("long").alias("function_count_dropped"), F.size(F.filter(functions, lambda f: f["depth"] > 0)).cast("long").alias("function_count_nested"),
        F.size(F.filter(functions, lambda f: f["depth"] == 0)).cast("long").alias("function_count_outermost"),
        F.transform(F.sort_array(F.transform(functions, lambda f: F.struct(f["source_order"].alias("o"), f["name"].alias("n")))), lambda x: F.length(text.short_name(x["n"]))).alias("function_name_lengths"),
    ]
    for m in schemas.FUNCTION_METRICS:
        v = F.array_sort(F.transform(fine, lambda f: f[m]))  # noqa: B023
        n, some = F.size(v), F.size(v) > 0
        total = F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        mid = lambda i: F.get(v, (i / 2).cast("int"))  # noqa: B023, E731
        median = (mid(n - 1) + mid(n)) / 2
        values = {"sum": total, "mean": F.try_divide(total, n.cast("double")), "median": median, "min": F.get(v, F.lit(0)), "max": F.get(v, n - 1)}
        out += [F.when(some, x).alias(f"{m}_{k}") for k, x in values.items()]
    return out


def with_structure(base: DataFrame, rows: int | None = None) -> DataFrame:
    """Base (task_id, language, code, signature, human_metrics) with facts, functions and the flags that follow from them.

    Code is read in small parts, which no join before puts together; rows: how many base has, where that is known.
    """
    samples = base.select("task_id", "language", "code", F.col("signature.name").alias("name"), F.col("signature.arity").alias("arity"))
    facts = scan.with_facts(spread(samples, base.count() if rows is None else rows, "task_id"))
    x = base.join(facts, "task_id")
    f = lambda n: F.col(f"facts.{n}")
    h = lambda n: F.col(f"human_metrics.{n}")
    empty, known = f("empty"), ~f("empty") & f("failure").isNull()
    share = lambda n: F.when(empty, 0.0).when(known, gates.ratio(f(n), h(n)))
    x = x.withColumn("target_token_ratio", share("token_count")).withColumn("target_ast_ratio", share("ast_node_count"))
    x = x.withColumn("undersized", empty | known & gates.undersized(f("statement_count"), F.col("target_token_ratio"), F.col("target_ast_ratio")))
    x = x.withColumn("explicit_stub", empty | known & f("stub"))
    x = x.withColumn("nonstub", known & f("parseable") & f("target_present") & f("arity_ok") & ~F.col("explicit_stub"))
    return x.withColumn("structural_strict_nontrivial", F.col("nonstub") & ~f("constant") & ~F.col("undersized"))


def judged(x: DataFrame) -> DataFrame:
    """The result columns of rows with structure and a complexity struct (nloc_mean, halstead_volume_mean, ...)."""
    f = lambda n: F.col(f"facts.{n}")
    empty, known = f("empty"), ~f("empty") & f("failure").isNull()
    shape = gates.status(f("parseable") & known, f("target_present"), f("arity_ok"), F.col("explicit_stub"), f("constant"), F.col("undersized"))
    r1, r2, ok = gates.complexity_gate(F.col("complexity.nloc_mean"), F.col("complexity.halstead_volume_mean"), F.col("human_complexity.nloc"), F.col("human_complexity.halstead_v"))
    x = x.withColumn("complexity_nloc_ratio", r1).withColumn("complexity_halstead_volume_ratio", r2).withColumn("complexity_non_degenerate", ok)
    strict = F.col("structural_strict_nontrivial")
    status = F.when(empty, "empty").when(strict & ~F.col("complexity_non_degenerate"), "complexity_degenerate").otherwise(shape)
    diagnostics = F.filter(F.array(F.when(empty, "empty output"), f("failure"), F.when(known & ~f("parseable"), "brackets do not match")), lambda d: d.isNotNull())
    return x.select(
        F.lit(schemas.BENCHMARK_VERSION).alias("benchmark_version"), "task_id", "language", "stratum", "submitted",
        (f("parseable") & known).alias("parseable"), f("target_present").alias("target_present"), f("arity_ok").alias("target_matches_arity"), "explicit_stub",
        f("constant").alias("constant_noop_only"), "undersized", "nonstub", (strict & F.col("complexity_non_degenerate")).alias("strict_nontrivial"), status.alias("status"),
        f("token_count").alias("token_count"), f("ast_node_count").alias("ast_node_count"), f("statement_count").alias("statement_count"), "target_token_ratio", "target_ast_ratio",
        diagnostics.alias("diagnostics"), "structural_strict_nontrivial", "complexity_nloc_ratio", "complexity_halstead_volume_ratio", "complexity_non_degenerate", "complexity",
        text.lexical_set(F.col("code")).alias("lexical_tokens"),
    )


def evaluate(tasks: DataFrame, references: DataFrame, predictions: DataFrame, defects: DataFrame | None = None, vulnerabilities: DataFrame | None = None, categories: DataFrame | None = None) -> DataFrame:
    """One result row for each task.

    defects (task_id, rule, odc, line) and vulnerabilities (task_id, cwes, severity, lines) are analyzer findings. With
    categories (rule, odc) the category of a finding is that of its first alias that has one. Findings that its language leaves
    out do not count; without findings outcomes are null, `cwes` is empty and the analysis status is skipped. One pass of Python reads the code; joins
    on task_id, gates and statuses are the planner's.
    """
    validate(tasks, predictions)
    base = joins.matched(joins.with_predictions(tasks, predictions), references, ["task_id"], "tasks and references differ")
    x = with_structure(base, tasks.count())
    out = judged(x.withColumn("complexity", F.struct(*function_aggregate(F.col("functions")))))
    if defects is None or vulnerabilities is None:
        nulls = [F.lit(None).cast("long").alias(c) for c in schemas.OUTCOMES]
        return out.select("*", *nulls, F.array().cast("array<string>").alias("cwes"), F.lit("skipped").alias("static_analysis_status"))
    if categories is not None:
        defects = findings.resolved(defects, categories)
    counted = defects.join(tasks.select("task_id", "language"), "task_id").where(findings.countable(F.col("language"), F.col("rule"), F.col("odc")))
    d = findings.defect_counts(tasks, counted, ["task_id"])
    v = findings.vulnerability_counts(tasks, vulnerabilities, ["task_id"])
    return out.join(d, "task_id").join(v, "task_id").withColumn("static_analysis_status", F.lit("ok"))


def summarize(results: DataFrame) -> DataFrame:
    """One row a language; a mean without values is null."""
    clean = lambda c: F.col(c) & gates._zero("defects_total") & gates._zero("vulns_total")
    scanned = F.col("defects_total")
    strict = F.col("strict_nontrivial")
    means = [gates.mean_if(F.col(f"complexity.{m}_{k}"), strict).alias(f"{m}_{k}") for m in schemas.FUNCTION_METRICS for k in ("mean", "sum")]
    lengths = F.when(strict, F.col("complexity.function_name_lengths"))
    rows = results.groupBy("language").agg(
        F.count("*").alias("tasks"),
        *[gates.rate(F.col(c)).alias(c) for c in ("submitted", "parseable", "target_present", "nonstub", "strict_nontrivial")],
        *[gates.incidence(F.col(c), scanned).alias(f"{c}_incidence") for c in schemas.OUTCOMES],
        *[F.when(F.count(scanned) == F.count(F.lit(1)), gates.rate(clean(c))).alias(n) for c, n in (("nonstub", "clean_nonstub_at_1"), ("strict_nontrivial", "clean_strict_at_1"))],
        *means,
        gates.members(lengths)[0].alias("function_name_length_mean"),
        gates.mean_if(F.col("token_count"), strict).alias("target_token_count_mean"),
    )
    distinct = results.select("language", F.explode("lexical_tokens").alias("t")).distinct().groupBy("language").agg(F.count("*").alias("distinct_tokens"))
    return rows.join(distinct, "language", "left").fillna(0, ["distinct_tokens"])


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("language", "status").agg(F.count("*").alias("tasks"))
