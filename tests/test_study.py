import json

import pytest
from pyspark.sql import functions as F

from codegauge import cli, schemas
from codegauge.functions import scan, text
from codegauge.operators import contracts, joins, sets
from codegauge.plans import report
from codegauge.sources import jsonl, sinks


def table(spark, rows):
    """A metrics table: (hm_index, author, defects, vulnerabilities)."""
    n = len(schemas.METRICS)
    return spark.createDataFrame([(k, a, 10, 1, *[1.0] * n, d, d, 0, 0, 0, 0, 0, v, 0) for k, a, d, v in rows], schemas.METRICS_LONG)


def test_validation_report(spark, tmp_path):
    rows = [("a", "human", 0, 0), ("b", "human", 2, 0), ("c", "human", 1, 3), ("a", "dsc", 0, 1), ("b", "qwen", 0, 0)]
    df = table(spark, rows).withColumn("naturalness", F.when(F.col("hm_index") != "a", F.col("naturalness")))
    got = report.validated_table(df, str(tmp_path / "t"), "c", 4)
    human = got["authors"]["human"]
    assert (human["sample_rows"], human["samples_missing"]) == (3, 1)
    assert human["predictor_nulls"]["naturalness"] == 1 and human["predictor_nulls"]["sample_nloc"] == 0
    assert human["outcome_zero_counts"]["defects_total"] == 1 and human["outcome_zero_counts"]["vulns_total"] == 2
    assert got["authors"]["gptoss"]["sample_rows"] == 0 and got["worked_example"]["hm_index"] == "c"
    assert report.worked_example(df.where("hm_index <> 'c'"))["hm_index"] == "b" and report.worked_example(df.where("author = 'dsc'")) is None
    with pytest.raises(ValueError):
        report.validated_table(df.withColumn("author", F.lit("nobody")), str(tmp_path / "u"), "c", 4)
    df.write.parquet(str(tmp_path / "in"))
    cli.main(["build-table", "--metrics", str(tmp_path / "in"), "--output-dir", str(tmp_path / "out"), "--language", "c", "--dataset-rows", "4"], spark)
    assert json.load(open(tmp_path / "out" / "validation.json")) == got


def test_field_specs():
    assert text.field_spec("human_code : Python") == ("human_code", "python")
    for bad in ("human_code", "x:cobol", "x:"):
        with pytest.raises(ValueError):
            text.field_spec(bad)


def test_functions_as_rows(spark, tmp_path):
    code = "def f(a):\n    def g():\n        return 1\n    return g\n\ndef h():\n    return 2\n"
    path = tmp_path / "in.json"
    path.write_text(json.dumps({"id": 1, "python": code, "c": "int f(void) { return 1; }"}) + "\n" + json.dumps({"id": 2, "python": "x = 1", "c": None}) + "\n")
    cli.main(["list-functions", "--dataset", str(path), "--key", "id", "--output", str(tmp_path / "out"), "--field", "python:python", "--field", "c:c"], spark)
    rows = {r.function_uid: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert {u: (r.name, r.parent_uid, r.source_order) for u, r in rows.items()} == {"1:python:0": ("f", None, 0), "1:python:1": ("f.g", "1:python:0", 1), "1:python:2": ("h", None, 2), "1:c:0": ("f", None, 0)}
    assert rows["1:python:1"].short_name == "g" and rows["1:python:2"].detected == 3


def test_code_is_attached_to_every_row(spark):
    dataset = spark.createDataFrame([("a", "x = 1\n", None), ("b", "y", "z\n\nz")], "hm_index string, h string, m string")
    fields = {"human": "h", "model": "m"}
    selected = spark.createDataFrame([("a", "human"), ("b", "human"), ("b", "model")], "hm_index string, author string")
    got = {(r.hm_index, r.author): r.sample_nloc for r in scan.sample_nloc(joins.attach_code(selected, dataset, fields), "python").collect()}
    assert got == {("a", "human"): 1, ("b", "human"): 1, ("b", "model"): 2}
    for bad in (("c", "human"), ("a", "nobody"), ("a", "model")):
        with pytest.raises(Exception):
            scan.sample_nloc(joins.attach_code(spark.createDataFrame([bad], selected.schema), dataset, fields), "python").collect()


def test_rules_and_sets(spark):
    df = spark.createDataFrame([(1, 3, 2, 1), (2, 3, 4, 0), (3, None, 1, 1)], "i int, function_count_detected int, function_count_computable int, function_count_dropped int")
    got = sorted((r.i, r.rule.split()[0]) for r in contracts.broken_rules(df, ["i"], contracts.FUNCTION_COUNTS).collect())
    assert got == [(2, "computable"), (2, "dropped"), (3, "computable"), (3, "dropped")]
    a, b = (spark.createDataFrame([(x,) for x in s], "k string") for s in (["a", "b", None, "a"], ["b", None, "c"]))
    assert {r.k for r in sets.intersection(a, b, ["k"]).collect()} == {"b", None}
    assert {r.k for r in sets.not_covered(a, [b], ["k"]).collect()} == {"a"}
    assert {r.name: r.n for r in sets.sizes(a, b, ["k"], {"x": "both", "y": "either", "z": "right"}).collect()} == {"x": 2, "y": 4, "z": 1}


def test_ordinals_over_files(spark, tmp_path):
    for n, keys in (("b.json", "cd"), ("a.json", "xab")):
        (tmp_path / n).write_text("\n\n".join(json.dumps({"key": k}) for k in keys) + "\n")
    assert {r.key: r.idx for r in jsonl.dataset_keys(spark, str(tmp_path), "key").collect()} == {"x": 0, "a": 1, "b": 2, "c": 3, "d": 4}


def test_long_reports_are_refused(spark):
    assert sinks.markdown(spark.range(3), most=3).count("\n") == 5
    with pytest.raises(ValueError):
        sinks.markdown(spark.range(4), most=3)


def test_percent_of_nothing(spark):
    df = spark.createDataFrame([(0.125,), (None,), (1.0,)], "x double")
    assert [r[0] for r in df.select(text.percent(F.col("x"))).collect()] == ["12.5%", "—", "100.0%"]
