"""Results of frozen study runs, from the metrics table instead of live analysis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..operators import contracts, gates, joins
from . import evaluate


def author_of(model: str, language: Column) -> Column:
    """P16: "openai" is gptoss for C and chatgpt elsewhere; other names stand for themselves."""
    return gates.cascade([(language == "c", "gptoss")], "chatgpt") if model == "openai" else F.lit(model)


def results(tasks: DataFrame, references: DataFrame, baseline: DataFrame, metrics: DataFrame, model: str) -> DataFrame:
    """One result a task: structure from the baseline's code, complexity means and outcomes from metrics (language, hm_index, author, ...).

    Each task needs exactly one metrics row. All count as submitted, and no CWEs are listed.
    """
    for other, name in ((references, "references"), (baseline, "baseline")):
        contracts.enforce(contracts.unequal_keys(tasks, other, ["task_id"]), f"tasks and {name} differ")
    mine = metrics.withColumnRenamed("hm_index", "source_id").join(tasks.select("language", "source_id").distinct(), ["language", "source_id"], "left_semi")
    mine = mine.where(F.col("author") == author_of(model, F.col("language")))
    contracts.enforce(contracts.missing(tasks, mine, ["language", "source_id"]), "no metrics for")
    contracts.enforce(mine.groupBy("language", "source_id").count().where("count > 1"), "several metrics rows for")
    named = {table: stored for stored, table in schemas.TABLE_NAME_OF.items()}
    complexity = F.struct(F.lit("ok").alias("analysis_status"), "function_count_computable", *[F.col(c).alias(n) for c, n in named.items()])
    mine = mine.select("language", "source_id", complexity.alias("complexity"), *schemas.OUTCOMES)
    base = tasks.join(baseline.select("task_id", "code"), "task_id").join(references, "task_id").withColumn("submitted", F.lit(True))
    x = evaluate.with_structure(base).join(mine, ["language", "source_id"])
    out = evaluate.judged(x)
    return out.join(x.select("task_id", *schemas.OUTCOMES), "task_id").withColumn("cwes", F.array().cast("array<string>")).withColumn("static_analysis_status", F.lit("precomputed_frozen_study_results"))


def subset(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """The results of the tasks, in the tasks' order."""
    contracts.enforce(contracts.bad_keys(tasks, "task_id"), "task_id in tasks")
    contracts.enforce(contracts.bad_keys(results, "task_id"), "task_id in results")
    return joins.ordered_subset(results, tasks.select("task_id", "ordinal"))
