import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codegauge import schemas
from codegauge.functions import scan
from codegauge.operators import contracts
from codegauge.plans import build, evaluate, report
from codegauge.sources import jsonl, sinks

HUMAN = {"python": "def increment(value):\n    total = value + 1\n    return total\n", "java": "int twice(int value) {\n    int r = value * 2;\n    return r;\n}\n"}


def inputs(spark, codes):
    tasks, refs = [], []
    for language, code in HUMAN.items():
        text, name, arity = scan.signature_of(code, language)
        f = scan.structure_facts(code, language, name, arity)
        fn = scan.functions_of(code, language)[0]
        tasks.append((schemas.BENCHMARK_VERSION, f"{language}:1", language, "1", "clean_control", "doc", (text, name, arity), "p"))
        human = (True, True, True, False, False, False, True, True, "nontrivial", f["token_count"], f["ast_node_count"], f["statement_count"], 1.0, 1.0, [])
        refs.append((f"{language}:1", human, (fn["nloc"], fn["halstead_volume"]), "sha"))
    return spark.createDataFrame(tasks, schemas.TASK), spark.createDataFrame(refs, schemas.REFERENCE), spark.createDataFrame(list(codes.items()), schemas.PREDICTION)


def statuses(spark, codes):
    out = evaluate.evaluate(*inputs(spark, codes))
    return {r.task_id: r for r in out.collect()}


@pytest.mark.parametrize(
    "task,code,want",
    [
        ("python:1", HUMAN["python"], "nontrivial"), ("java:1", HUMAN["java"], "nontrivial"), ("python:1", "", "empty"), ("python:1", "def increment(:", "parse_error"),
        ("python:1", "def other(value):\n    return value + 1\n", "target_missing"), ("python:1", "def increment():\n    return 1 + f()\n", "arity_mismatch"),
        ("python:1", "def increment(value):\n    pass\n", "explicit_stub"), ("java:1", "int twice(int value) { return 0; }", "constant_noop"), ("java:1", "int twice(int value) { return (", "parse_error"),
    ],
)
def test_status(spark, task, code, want):
    got = statuses(spark, {task: code})
    assert got[task].status == want and got[task].submitted
    other = got["java:1" if task == "python:1" else "python:1"]
    assert (other.status, other.submitted, other.explicit_stub, other.undersized, other.target_token_ratio) == ("empty", False, True, True, 0.0)
    assert got[task].strict_nontrivial == (want == "nontrivial") and got[task].static_analysis_status == "skipped" and got[task].defects_total is None


def test_findings_summary_and_comparison(spark):
    tasks, refs, preds = inputs(spark, {f"{k}:1": v for k, v in HUMAN.items()})
    defects = spark.createDataFrame([("python:1", "r", "Checking", 1)], "task_id string, rule string, odc string, line long")
    vulns = spark.createDataFrame([("java:1", ["CWE-1"], "ERROR", "x")], "task_id string, cwes array<string>, severity string, lines string")
    results = evaluate.evaluate(tasks, refs, preds, defects, vulns)
    s = {r.language: r for r in evaluate.summarize(results).collect()}
    assert s["python"].clean_strict_at_1 == 0.0 and s["python"].defects_total_incidence == 1.0 and s["java"].vulns_high_sev_incidence == 1.0
    assert s["python"].tasks == 1 and s["python"].nloc_mean == 3.0 and s["python"].distinct_tokens == 11 and s["python"].function_name_length_mean == len("increment")
    none = evaluate.evaluate(tasks, refs, preds)
    assert evaluate.summarize(none).where("clean_strict_at_1 is not null").count() == 0
    got = report.compare(results, {"self": results}, resamples=50).collect()
    assert len(got) == 20 and all(r.delta == 0 and r.ci_lo == r.ci_hi == 0 and r.n == 1 for r in got)
    assert {r.metric for r in report.compare(none, {"self": none}, 10).collect()} == {"submitted_rate", "parseable_rate", "target_present_rate", "nonstub_rate", "strict_nontrivial_rate"}
    d = {(r.scope, r.metric): r.incidence for r in report.distributions(results.withColumn("author", F.lit("m"))).collect()}
    assert d["ALL", "defects_total"] == 0.5 and d["python", "defects_total"] == 1.0
    assert {(r.scope, r.cwe): r["count"] for r in report.cwe_distribution(results.withColumn("author", F.lit("m"))).collect()} == {("ALL", "CWE-1"): 1, ("java", "CWE-1"): 1}
    assert report.odc_table(results).where("odc = 'def_checking' and python = 1 and java = 0").count() == 1


def test_predictions_are_validated(spark):
    tasks, refs, preds = inputs(spark, {"python:1": "x"})
    for bad in (preds.union(preds), preds.withColumn("task_id", F.lit("unknown")), preds.withColumn("code", F.lit(None).cast("string"))):
        with pytest.raises(contracts.ContractError):
            evaluate.evaluate(tasks, refs, bad)
    with pytest.raises(contracts.ContractError):
        evaluate.evaluate(tasks, refs.limit(1), preds)


def metrics(spark, found):
    out = []
    for key, by in found.items():
        for author, (nloc, checking, vulns) in by.items():
            out.append((key, author, 10, 1, *[float(nloc)] * 13, checking, 0, 0, 0, checking, 0, 0, vulns, vulns))
    return spark.createDataFrame(out, schemas.METRICS_LONG)


def test_build(spark):
    easy = {a: (10, 0, 0) for a in schemas.AUTHORS["c"]}
    hard = {**easy, "gptoss": (10, 3, 1), "dsc": (10, 4, 0)}
    m = metrics(spark, {"easy": easy, "hard": hard, "copy": hard, "gate": {**hard, "dsc": (0.5, 9, 9)}, "cwe": {**easy, "gptoss": (9, 0, 5), "qwen": (9, 0, 4)}, "part": {"human": (1, 9, 9)}, "stub": hard})
    found = build.evidence(m, "c", 3)
    assert {r.hm_index: r.difficulty.score for r in found.collect()} == {"hard": 4, "copy": 4, "stub": 4, "cwe": 4}
    raw = spark.createDataFrame([("cwe", "gptoss", "CWE-7"), ("cwe", "qwen", "CWE-7"), ("cwe", "qwen", "CWE-8"), ("hard", "dsc", "CWE-1")], "hm_index string, author string, cwe string")
    cwes = build.consensus_cwes(found, raw)
    assert {r.hm_index: r.consensus_cwes for r in cwes.collect()} == {"cwe": ["CWE-7"]}
    chosen = build.eligible(found, cwes)
    assert {r.hm_index: r.stratum for r in chosen.collect()} == {"hard": "defect_consensus", "copy": "defect_consensus", "stub": "defect_consensus", "cwe": "vulnerability_consensus"}
    human = (True, True, True, False, False, False, True, True, "nontrivial", 1, 1, 1, 1.0, 1.0, [])
    rows = [("hard", "d", ("s", "n", 1), "code", human, 1), ("copy", "d", ("s", "n", 1), "code", human, 2), ("cwe", " ", ("s", "n", 1), "code2", human, 3), ("stub", "d", ("s", "n", 1), "code3", (*human[:7], False, *human[8:]), 4)]
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("hm_index", T.StringType()), T.StructField("docstring", T.StringType()), T.StructField("signature", schemas.SIGNATURE), T.StructField("human_code", T.StringType()), T.StructField("human_metrics", schemas.STRUCTURE), T.StructField("ordinal", T.LongType())])
    kept, dropped = build.tasks(spark.createDataFrame(rows, schema), chosen, "c")
    assert [r.task_id for r in kept.collect()] == ["c:hard"]
    assert {r.why: r.n for r in dropped.collect()} == {"exact_duplicate": 1, "missing_prompt_or_human": 1, "human_not_strict": 1}
    assert build.benchmark([kept], 1).count() == 1
    with pytest.raises(contracts.ContractError):
        build.benchmark([kept], 2)


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "in.jsonl")
    with open(path, "w") as f:
        f.write('{"task_id": "a", "code": "x"}\n\n  \n{"task_id": "b", "code": "y"}\n')
    assert [(r.task_id, r.code) for r in jsonl.load_index(spark, path, schemas.PREDICTION, "task_id").orderBy("ordinal").collect()] == [("a", "x"), ("b", "y")]
    assert [(r.key, r.idx) for r in jsonl.dataset_keys(spark, path, "task_id").orderBy("idx").collect()] == [("a", 0), ("b", 1)]
    for bad in ('{"task_id": 3, "code": "x"}\n', '[{"task_id": "a"}]\n', '{"task_id": "a"}\n{"task_id": "a"}\n', "nonsense\n"):
        other = str(tmp_path / "bad.jsonl")
        with open(other, "w") as f:
            f.write(bad)
        with pytest.raises(Exception):
            jsonl.load_index(spark, other, schemas.PREDICTION, "task_id").count()
    with open(other, "w") as f:
        f.write('{"task_id": "a", "code": "x"}\nnonsense\n[1]\n')
    assert jsonl.read_jsonl(spark, other, schemas.PREDICTION, tolerant=True).count() == 1 and jsonl.rejected(spark, other).count() == 2
    got = jsonl.transformed_lines(spark, other, "code", F.upper).collect()
    assert [r.value for r in got][1:] == ["nonsense", "[1]"] and json.loads(got[0].value) == {"task_id": "a", "code": "X"} and [r.changed for r in got] == [True, False, False]
    with open(other, "w") as f:
        f.write('{"n":3,"code":"a b","ok":true,"tags":["x",1],"o":{"k":null}}\n\n{"code": 5}\n')
    kept = [r.value for r in jsonl.transformed_lines(spark, other, "code", F.upper).collect()]
    assert kept == ['{"n": 3, "code": "A B", "ok": true, "tags": ["x", 1], "o": {"k": null}}', "", '{"code": 5}']
    normed = jsonl.transformed_lines(spark, other, "code", F.upper, keep_original=True).first()
    assert json.loads(normed.value) == {"n": 3, "code": "a b", "ok": True, "tags": ["x", 1], "o": {"k": None}, "code_norm": "A B"}
    with pytest.raises(FileNotFoundError):
        jsonl.require_inputs(spark, [path, path + ".none"], [str(tmp_path)])
    with pytest.raises(contracts.ContractError):
        jsonl.only(spark.createDataFrame([("a",)], "k string"), "k", ["b"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", None)], "k string, v double")
    assert sinks.write_jsonl(df, f"{tmp_path}/j") == 2
    with pytest.raises(Exception):
        sinks.write_jsonl(df, f"{tmp_path}/j")
    with pytest.raises(Exception, match="not finite"):
        sinks.write_jsonl(df.withColumn("v", F.lit(float("nan"))), f"{tmp_path}/n")
    assert sinks.write_table(df, f"{tmp_path}/t") == 2
    sinks.write_document({"b": 1, "a": [0.5]}, df, f"{tmp_path}/d.json")
    with open(f"{tmp_path}/d.json") as f:
        assert f.read() == '{\n  "a": [\n    0.5\n  ],\n  "b": 1\n}\n'
    with pytest.raises(FileExistsError):
        sinks.write_document({}, df, f"{tmp_path}/d.json")
    sinks.write_by_author(df.withColumnRenamed("k", "author"), f"{tmp_path}/w")
    assert spark.read.json(f"{tmp_path}/w").count() == 2
    assert "| a | 100.0% |" in sinks.markdown(df, ("v",)) and "—" in sinks.markdown(df)


def test_registered_queries(spark):
    import __spark_entry__

    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and len(names) >= 50
    assert __spark_entry__.entry(spark).count() == 4
    assert Counter(type(q).__name__ for q in names.values()) == Counter({"function": len(names)})


def test_stream(spark, tmp_path):
    from codegauge.streaming.evaluate import evaluate_stream

    tasks, refs, preds = inputs(spark, {f"{k}:1": v for k, v in HUMAN.items()})
    preds.write.json(f"{tmp_path}/in")
    stream = spark.readStream.schema(schemas.PREDICTION).json(f"{tmp_path}/in")
    query = evaluate_stream(tasks, refs, stream, f"{tmp_path}/out", f"{tmp_path}/check")
    query.awaitTermination(120)
    assert {r.status for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"nontrivial"}


def test_historical_results(spark):
    from codegauge.plans import historical

    tasks, refs, preds = inputs(spark, {f"{k}:1": v for k, v in HUMAN.items()})
    m = metrics(spark, {"1": {a: (10, 2, 1) for a in schemas.AUTHORS["java"]}})
    table = m.withColumn("language", F.lit("java")).union(m.withColumn("language", F.lit("python")))
    got = {r.task_id: r for r in historical.results(tasks, refs, preds, table, "openai").collect()}
    assert {r.static_analysis_status for r in got.values()} == {"precomputed_frozen_study_results"}
    assert got["java:1"].defects_total == 2 and got["java:1"].complexity.nloc_mean == 10.0 and got["java:1"].strict_nontrivial and got["java:1"].cwes == []
    with pytest.raises(contracts.ContractError):
        historical.results(tasks, refs, preds, m.withColumn("language", F.lit("java")), "openai")


def test_command_line(spark, tmp_path, capsys):
    from codegauge import cli

    tasks, refs, preds = inputs(spark, {f"{k}:1": v for k, v in HUMAN.items()})
    for name, df in (("tasks", tasks), ("refs", refs), ("preds", preds)):
        df.write.json(f"{tmp_path}/{name}")
    run = lambda *a: cli.main([*a], spark)
    given = ["--tasks", f"{tmp_path}/tasks", "--predictions", f"{tmp_path}/preds"]
    run("validate-submission", *given)
    run("evaluate", *given, "--references", f"{tmp_path}/refs", "--output", f"{tmp_path}/out")
    run("subset-results", "--tasks", f"{tmp_path}/tasks", "--results", f"{tmp_path}/out", "--output", f"{tmp_path}/sub")
    run("compare", "--submission", f"{tmp_path}/out", "--baseline", f"{tmp_path}/sub", "--output", f"{tmp_path}/cmp")
    run("report", "--results", f"{tmp_path}/out", "--output-dir", f"{tmp_path}/rep", "--model-name", "m")
    assert "| java | 1 | 100.0% |" in capsys.readouterr().out
    rows = spark.read.csv(f"{tmp_path}/cmp", header=True).collect()
    assert len(rows) == 10 and {r.delta for r in rows} == {"0.0"}
