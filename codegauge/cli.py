"""Command line: python -m codegauge <command>. Inputs and outputs are paths of any file system that Spark knows."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas
from .functions import scan, text
from .plans import build, evaluate, historical, report
from .sources import jsonl, sinks


def _load(spark: SparkSession, path: str, schema) -> DataFrame:
    return jsonl.load_index(spark, path, schema, "task_id")


def _results(spark: SparkSession, path: str) -> DataFrame:
    """Results as `evaluate` writes them: a folder of JSON lines. Outcomes that are null throughout have no type there."""
    df = spark.read.json(path)
    return df.withColumns({c: F.col(c).cast("long") for c in schemas.OUTCOMES})


def validate_submission(spark, a) -> None:
    evaluate.validate(_load(spark, a.tasks, schemas.TASK), _load(spark, a.predictions, schemas.PREDICTION))


def run_evaluate(spark, a) -> None:
    found = {n: spark.read.json(p, schema=s) if p else None for n, p, s in (("defects", a.defects, "task_id string, rule string, odc string, line long"), ("vulnerabilities", a.vulnerabilities, "task_id string, cwes array<string>, severity string, lines string"))}
    tasks = _load(spark, a.tasks, schemas.TASK).drop("ordinal")
    if a.categories:
        found["categories"] = jsonl.read_map(spark, a.categories)
    out = evaluate.evaluate(tasks, _load(spark, a.references, schemas.REFERENCE).drop("ordinal"), _load(spark, a.predictions, schemas.PREDICTION).drop("ordinal"), **found)
    print(sinks.write_jsonl(out, a.output, a.overwrite))


def subset_results(spark, a) -> None:
    print(sinks.write_jsonl(historical.subset(_results(spark, a.results), _load(spark, a.tasks, schemas.TASK)), a.output, a.overwrite))


def historical_results(spark, a) -> None:
    metrics = None
    for pair in a.metrics:
        language, _, path = pair.partition("=")
        part = spark.read.parquet(path).withColumn("language", F.lit(language))
        metrics = part if metrics is None else metrics.unionByName(part)
    out = historical.results(_load(spark, a.tasks, schemas.TASK).drop("ordinal"), _load(spark, a.references, schemas.REFERENCE).drop("ordinal"), _load(spark, a.baseline, schemas.PREDICTION).drop("ordinal"), metrics, a.model)
    print(sinks.write_jsonl(out, a.output, a.overwrite))


def build_large(spark, a) -> None:
    """Hard tasks of one language from its metrics, dataset rows and raw findings."""
    found = build.evidence(jsonl.read_table(spark, a.metrics, [f.name for f in schemas.METRICS_LONG.fields]), a.language, a.difficulty_threshold)
    chosen = build.eligible(found, build.consensus_cwes(found, spark.read.parquet(a.findings)))
    tasks, dropped = build.tasks(spark.read.parquet(a.dataset), chosen, a.language)
    sinks.write_jsonl(tasks.drop("human_metrics", "content_sha256"), f"{a.output_dir}/tasks", a.overwrite)
    sinks.write_jsonl(tasks.select("task_id", "human_metrics", F.col("difficulty.human_complexity").alias("human_complexity"), "content_sha256"), f"{a.output_dir}/references", a.overwrite)
    sinks.write_csv(dropped, f"{a.output_dir}/dropped", a.overwrite)


def compare(spark, a) -> None:
    baselines = {p.rstrip("/").rpartition("/")[2].partition(".")[0]: _results(spark, p) for p in a.baseline}
    sinks.write_csv(report.compare(_results(spark, a.submission), baselines).orderBy("baseline", "language", "metric"), a.output, a.overwrite)


def write_report(spark, a) -> None:
    results = _results(spark, a.results)
    summary = evaluate.summarize(results).withColumn("model", F.lit(a.model_name)).orderBy("language")
    sinks.write_csv(summary, f"{a.output_dir}/summary", a.overwrite)
    rows = [json.loads(r) for r in summary.toJSON().collect()]  # a row for each language
    sinks.write_document({"model": a.model_name, "languages": {r["language"]: r for r in rows}}, results, f"{a.output_dir}/summary.json", a.overwrite)
    rates = ("nonstub", "strict_nontrivial", "defects_total_incidence", "vulns_total_incidence", "vulns_high_sev_incidence", "clean_strict_at_1")
    print(sinks.markdown(summary.select("language", "tasks", *rates), rates))
    sinks.write_csv(report.odc_table(results), f"{a.output_dir}/odc_incidence", a.overwrite)


def merge_rules(spark, a) -> None:
    """Fetched rules (id, body) as JSON lines, merged by id; conflicting bodies raise."""
    from .operators import contracts

    merged, conflicts = jsonl.merged_rules(spark.read.json(a.rules, schema="id string, body string"))
    contracts.enforce(conflicts, "conflicting rules")
    print(sinks.write_jsonl(merged, a.output, a.overwrite))


def list_functions(spark, a) -> None:
    """Every function of the fields of a dataset of JSON lines; each field is given as field:language."""
    specs = [text.field_spec(x) for x in a.field]
    rows = spark.read.json(a.dataset)
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.lit(g).alias("language"), F.col(f).cast("string").alias("code")) for f, g in specs])).alias("x")
    samples = rows.select(F.col(a.key).cast("string").alias("row_id"), cells).select("row_id", "x.*")
    print(sinks.write_jsonl(scan.function_records(samples).drop("code"), a.output, a.overwrite))


def build_table(spark, a) -> None:
    """Writes a metrics table as Parquet, with a validation report beside it."""
    found = report.validated_table(spark.read.parquet(a.metrics), f"{a.output_dir}/table", a.language, a.dataset_rows, a.overwrite)
    sinks.write_document(found, spark.read.parquet(f"{a.output_dir}/table"), f"{a.output_dir}/validation.json", a.overwrite)


COMMANDS = {
    "list-functions": (list_functions, ("dataset", "key", "output")),
    "build-table": (build_table, ("metrics", "output-dir")),
    "validate-submission": (validate_submission, ("tasks", "predictions")),
    "evaluate": (run_evaluate, ("tasks", "references", "predictions", "output")),
    "subset-results": (subset_results, ("tasks", "results", "output")),
    "historical-results": (historical_results, ("tasks", "references", "baseline", "output")),
    "build-large": (build_large, ("metrics", "dataset", "findings", "output-dir")),
    "compare": (compare, ("submission", "output")),
    "report": (write_report, ("results", "output-dir", "model-name")),
    "merge-rules": (merge_rules, ("rules", "output")),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codegauge")
    commands = out.add_subparsers(dest="command", required=True)
    for name, (_, needed) in COMMANDS.items():
        p = commands.add_parser(name)
        for n in needed:
            p.add_argument(f"--{n}", required=True)
        p.add_argument("--overwrite", action="store_true")
        if name == "evaluate":
            p.add_argument("--defects", help="findings as JSON lines; without both kinds outcomes are null")
            p.add_argument("--vulnerabilities")
            p.add_argument("--categories", help="rules and their categories as CSV; a finding's aliases are looked up in it")
        elif name == "historical-results":
            p.add_argument("--model", choices=("human", "openai", "dsc", "qwen"), required=True)
            p.add_argument("--metrics", action="append", required=True, help="language=path of a metrics table")
        elif name == "build-large":
            p.add_argument("--language", choices=schemas.LANGUAGES, required=True)
            p.add_argument("--difficulty-threshold", type=int, default=3)
        elif name == "list-functions":
            p.add_argument("--field", action="append", required=True, help="field:language")
        elif name == "build-table":
            p.add_argument("--language", choices=schemas.LANGUAGES, required=True)
            p.add_argument("--dataset-rows", type=int, required=True)
        elif name == "compare":
            p.add_argument("--baseline", action="append", required=True)
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    COMMANDS[args.command][0](spark or SparkSession.builder.appName("codegauge").getOrCreate(), args)
