import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge import schemas
from codegauge.operators import contracts, findings, gates, joins, ngram, stats, windows


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_contracts(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", -1.0), ("", 0.0), (None, float("nan"))], "k string, v double")
    assert rows(contracts.bad_keys(df, "k")) == Counter({("a", 2): 1, ("", 1): 1, (None, 1): 1})
    assert contracts.outside(df.where("k = 'a'"), "k", ("v",)).count() == 1
    with pytest.raises(contracts.ContractError, match="a"):
        contracts.enforce(contracts.bad_keys(df, "k"), "bad key")
    other = spark.createDataFrame([("a",), ("b",)], "k string")
    assert rows(contracts.unequal_keys(df.where("k = 'a'"), other, ["k"])) == Counter({("b", "right"): 1})
    assert contracts.too_few(df, 5).count() == 1 and contracts.too_few(df, 4).count() == 0
    assert contracts.conserved(df, df).count() == 0
    assert rows(contracts.uncovered(spark.createDataFrame([("x", "human")], "k string, author string"), spark.createDataFrame([("x",)], "k string"), ["human", "qwen"])) == Counter({("x", "qwen"): 1})


@pytest.mark.parametrize("nloc,volume,human,want", [(5.0, 50.0, (100.0, 1000.0), False), (5.0, 150.0, (100.0, 1000.0), True), (None, 150.0, (100.0, 1000.0), False), (0.0, 150.0, (100.0, 1000.0), False), (1.0, 1.0, (None, None), True)])
def test_gate(spark, nloc, volume, human, want):
    df = spark.createDataFrame([(nloc, volume, *human)], "a double, b double, c double, d double")
    r1, r2, ok = gates.complexity_gate(*(F.col(x) for x in "abcd"))
    got = df.select(r1, r2, ok).first()
    assert got[2] is want and (got[0] is None) == (nloc in (None, 0.0) or human[0] is None)


def test_findings(spark):
    found = spark.createDataFrame([("t", "r1", "Checking", 1), ("t", "r1", "Checking", 1), ("t", "r1", "Checking", 2), ("t", "r2", "Timing/Serialization", 1), ("t", "r3", "--", 1)], "task_id string, rule string, odc string, line long")
    keys = spark.createDataFrame([("t",), ("u",)], "task_id string")
    got = {r.task_id: r for r in findings.defect_counts(keys, found, ["task_id"]).collect()}
    assert (got["t"].defects_total, got["t"].def_checking, got["t"].def_timing) == (3, 2, 1) and got["u"].defects_total == 0
    with pytest.raises(Exception, match="unknown category"):
        findings.defect_counts(keys, found.withColumn("odc", F.lit("Nope")), ["task_id"]).collect()
    sast = spark.createDataFrame([("t", ["cwe-79: x"], "error", " a "), ("t", ["CWE-79"], "ERROR", "a"), ("t", [], "ERROR", "b"), ("u", ["CWE-1"], "INFO", "c")], "task_id string, cwes array<string>, severity string, lines string")
    got = {r.task_id: (r.vulns_total, r.vulns_high_sev, r.cwes) for r in findings.vulnerability_counts(keys, sast, ["task_id"]).collect()}
    assert got == {"t": (1, 1, ["CWE-79"]), "u": (1, 0, ["CWE-1"])}
    failed = keys.where("task_id = 'u'")
    assert {r.task_id: r.vulns_total for r in findings.vulnerability_counts(keys, sast, ["task_id"], failed).collect()}["u"] == 0
    names = spark.createDataFrame([("readability-x",), ("cert-a, misc-include-cleaner",), ("cert-a",), ("clang-analyzer-unix.API",)], "s string")
    assert [r[0] for r in names.where(~findings.excluded(F.col("s"), schemas.CLANG_EXCLUDED, schemas.CLANG_EXCLUDED_PREFIXES)).collect()] == ["cert-a"]


def test_joins(spark):
    alias, odc = joins.first_alias(F.col("s"), {"b": "Checking", "c": "Timing"})
    got = spark.createDataFrame([("a, c,b",), ("x",)], "s string").select(alias, odc).collect()
    assert [tuple(r) for r in got] == [("c", "Timing"), (None, None)]
    files = joins.java_files(spark.createDataFrame([("h", 3, "A b"), ("h", 1, "A b"), ("q", 2, "A b")], "author string, idx long, type_name string"))
    assert {(r.author, r.idx): r.file for r in files.collect()} == {("h", 1): "A_b.java", ("h", 3): "A_b_2.java", ("q", 2): "A_b.java"}
    spans = spark.createDataFrame([("f", 0, 1, 10), ("f", 1, 2, 5), ("f", 2, 2, 5), ("f", 3, 3, 4)], "row_id string, idx int, start int, end int")
    assert {r.idx: r.parent for r in joins.parents(spans).collect()} == {0: None, 1: 0, 2: 0, 3: 1}
    keys = spark.createDataFrame([("k0", 0), ("k1", 1)], "key string, idx long")
    paths = spark.createDataFrame([("a/b_2.py",), ("b_0.java",), ("x.py",)], "path string")
    assert {r.path: r.key for r in joins.by_path_ordinal(paths, keys).collect()} == {"a/b_2.py": "k1", "b_0.java": None, "x.py": None}
    with pytest.raises(contracts.ContractError):
        joins.paired(keys.union(keys), keys, ["key"])


def test_windows(spark):
    p = [0.01, 0.04, 0.03, 0.5, 0.02]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)] + [(9, None)], "i int, p double")
    got = {r.i: r.q for r in windows.benjamini_hochberg(df).collect()}
    order = sorted(range(5), key=lambda i: p[i])
    want = {i: min(1, min(p[j] * 5 / (order.index(j) + 1) for j in order[order.index(i) :])) for i in range(5)}
    assert got == {**{i: pytest.approx(q) for i, q in want.items()}, 9: None}
    a = windows.seeded_sample(spark.range(100).withColumnRenamed("id", "k"), "k", 10, 1)
    assert rows(a) == rows(windows.seeded_sample(spark.range(100).repartition(7).withColumnRenamed("id", "k"), "k", 10, 1)) and a.count() == 10
    assert windows.first_by_priority(df, [F.col("p") > 0.4, F.lit(True)], "i").first().i == 3


def test_bootstrap():
    rng = np.random.default_rng(stats.comparison_seed("openai", "c", "x"))
    v, c = np.array([-1.0, 0.0, 1.0]), np.array([3, 10, 7])
    means = rng.multinomial(20, c / 20, size=10_000) @ v / 20
    assert stats.bootstrap_interval(v, c, stats.comparison_seed("openai", "c", "x")) == tuple(np.percentile(means, [2.5, 97.5]))
    assert all(map(math.isnan, stats.bootstrap_interval(v, c, 1, 0)))
    many = np.arange(50.0)
    low, high = stats.bootstrap_interval(many, np.ones(50, int), 3, 500)
    assert low < many.mean() < high


def test_rank_statistics(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 10, 40), rng.integers(2, 12, 30)
    df = spark.createDataFrame([("m", 1, float(x)) for x in a] + [("m", 2, float(x)) for x in b], "metric string, side int, v double")
    r = stats.rank_sums(df, ["metric"], "side", "v").first()
    wins = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert r.u == pytest.approx(wins) and r.delta == pytest.approx(2 * wins / 1200 - 1)
    assert 0 < stats.mann_whitney_p(r.u, 40, 30, r.ties) < 0.05
    assert stats.mann_whitney_p(50, 10, 10, 20**3 - 20) == 1.0
    t, p = stats.welch(10, 5.0, 4.0, 12, 3.0, 9.0)
    assert t == pytest.approx(2 / math.sqrt(0.4 + 0.75)) and 0.05 < p < 0.1
    assert stats.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)
    w = stats.wilcoxon_sums(spark.createDataFrame([("k", 3.0, 1.0), ("k", 1.0, 2.0), ("k", 5.0, 5.0), ("z", 1.0, 1.0)], "k string, a double, b double"), ["k"], "a", "b")
    got = {r.k: (r.n, r.w_plus, r.w_minus, r.dominance) for r in w.collect()}
    assert got["k"] == (2, 2.0, 1.0, 0.5) and got["z"][0] == 0 and got["z"][3] == 0.5
    assert stats.wilcoxon_p(0, 0, 0) == 1.0
    pairs = stats.pairwise(df.select("metric", F.when(F.col("side") == 1, "x").otherwise("y").alias("author"), F.col("v").alias("value")), resamples=200).first()
    assert pairs.u == pytest.approx(wins) and pairs.ci_lo <= pairs.delta <= pairs.ci_hi and pairs.q_u == pytest.approx(pairs.p_u)


def test_ngram_probabilities_sum_to_one(spark):
    rng = np.random.default_rng(0)
    docs = spark.createDataFrame([(i, [str(x) for x in rng.choice(list("abcde"), int(rng.integers(1, 9)), p=[0.5, 0.2, 0.1, 0.1, 0.1])]) for i in range(60)], "sample_idx long, tokens array<string>")
    tables = ngram.train(ngram.counts_by_fold(docs.withColumn("fold", F.lit(0)), 3), 3)
    p1 = {r.gram[0]: r.p for r in tables[0].collect() if r.p is not None}
    assert sum(p1.values()) == pytest.approx(1)
    b1 = {r.gram[0]: r.backoff for r in tables[0].collect()}
    p2 = {tuple(r.gram): r.p for r in tables[1].collect() if r.p is not None}
    for ctx in {g[0] for g in p2}:
        assert sum(p2.get((ctx, w), b1[ctx] * p1[w]) for w in p1) == pytest.approx(1)
    got = {r.sample_idx: r for r in ngram.score(docs, tables).collect()}
    assert len(got) == 60 and all(r.cross_entropy_bits > 0 and r.cross_entropy_bits == pytest.approx(r.log10_per_token * math.log2(10)) for r in got.values())
    empty = ngram.score(spark.createDataFrame([(1, [])], "sample_idx long, tokens array<string>"), tables).first()
    assert empty.tokens == 0 and empty.cross_entropy_bits is None
    cv = ngram.cross_validated(docs, 2, 3)
    assert cv.count() == 60
