from pyspark.sql import functions as F

from codegauge.operators import findings


def test_countable(spark):
    rows = [
        ("python", "missing-module-docstring", "Interface", False), ("python", "GodClass", "Interface", True), ("java", "GodClass", "Interface", False), ("java", "EmptyCatchBlock", "Checking", True),
        ("c", "misc-include-cleaner", "Interface", False), ("c", "readability-x", "Checking", False), ("c", "bugprone-a, altera-b", "Checking", False), ("c", "google-doc", "Documentation", False),
        ("c", "bugprone-a", "Checking", True), ("python", "readability-x", "Checking", True), (None, "GodClass", "Checking", True), ("c", None, None, True), ("java", None, "Checking", True),
    ]
    got = spark.createDataFrame(rows, "language string, rule string, odc string, want boolean").select("*", findings.countable(F.col("language"), F.col("rule"), F.col("odc")).alias("ok")).collect()
    assert [r.ok for r in got] == [r.want for r in got]


def test_resolved(spark):
    found = spark.createDataFrame([(1, "a, b"), (2, "b,c"), (3, "x"), (4, None), (5, "c")], "i int, rule string")
    categories = spark.createDataFrame([("a", "--"), ("b", "Checking"), (" c", "Timing "), ("x", None)], "rule string, odc string")
    got = {r.i: (r.rule, r.odc) for r in findings.resolved(found, categories).collect()}
    assert got == {1: ("b", "Checking"), 2: ("b", "Checking"), 3: ("x", "--"), 4: (None, "--"), 5: ("c", "Timing")}
    assert findings.resolved(found.limit(0), categories).count() == 0
