import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.llm import knn, license_scan, shared, url_filter


def brute_top_k(rows, k):
    best = {}
    ids = sorted({i for i, _ in rows if i % 3 == 0})
    for q in ids:
        v = min(x for i, x in rows if i == q)
        scores = sorted(((-sum(a * b for a, b in zip(v, w)), i) for i, w in rows if i != q))[:k]
        for n, (s, i) in enumerate(scores, 1):
            best[q, n] = (i, -s)
    return best


@pytest.mark.parametrize("group,slices", [(256, 16384), (2, 7)])
def test_top_k_is_exact(spark, group, slices):
    rng = np.random.default_rng(4)
    centre = rng.integers(-900, 900, (5, 6))
    rows = [(i, (centre[i % 5] + rng.integers(-40, 40, 6)).tolist()) for i in range(150)]
    rows += [(1000 + i, [100] * 6) for i in range(60)]  # many equal vectors
    df = spark.createDataFrame([*[(i, v, 1) for i, v in rows], (2001, None, 1), (None, [1] * 6, 1)], "vec_id long, v array<long>, cell int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(df, F.col("vec_id") % 3 == 0, 4, pivots=8, group=group, slice_rows=slices).collect()}
    assert got == brute_top_k(rows, 4)


def test_top_k_edges(spark):
    kind = "vec_id long, v array<long>"
    assert knn.top_k(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    few = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [])], kind)
    got = knn.top_k(few, F.col("vec_id") == 0, 10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3), (2, 0)]
    big = spark.createDataFrame([(0, [1 << 31, 3]), (1, [1 << 31, 2]), (2, [1 << 31, 1])], kind)
    got = knn.top_k(big, F.col("vec_id") == 0, 10).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, (1 << 62) + 6), (2, (1 << 62) + 3)]


def test_whole_components(spark):
    df = spark.createDataFrame([(1, [0.5, -0.0005]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])], "i int, e array<float>")
    got = {r.i: r.v for r in df.select("i", knn.whole_components("e").alias("v")).collect()}
    assert got == {1: [512, -1], 2: None, 3: None, 4: None, 5: None, 6: []}


PAGES = "page_id long, url string, html string, host string, node string"


def test_urls(spark):
    canonical = lambda u: f'<html><LINK href="{u}" rel="canonical"><p>'
    rows = [
        (1, "http://A.Example.com/en/x?q#f", ""), (2, "https://www.example.com/en/", None), (3, "http://sub.www.example.com/en/1", "x"),
        (4, "http://foo.net/es/a", ""), (5, "http://foo.net/ES/a", ""), (6, "http://x.org/p", canonical("http://foo.net/fr/z")),
        (7, "http://y.org/q", '<meta http-equiv="refresh" content="0; url=//x.org/p">'), (8, "http://z.org/r", canonical("http://ok.com/")), (9, "http://z.org/r", ""),
        (10, None, canonical("http://foo.net/fr/z")), (11, "no scheme", ""), (12, "http://notcom", ""), (13, "http://com", ""), (14, "http://com/", ""),
        (15, "http://w.org/s", canonical("/r2")), (16, "http://w.org/r2", canonical("http://foo.net/es/")), (17, "http://mixed.org/", canonical("http://w.org/s")), (17, "http://mixed.org/", canonical("http://w.org/s")),
        (18, "http://free.com/a", canonical("http://foo.net/es/")),
    ]
    df = spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], PAGES)
    out = url_filter.judge(df)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert out.count() == len(rows)
    assert got[1] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[2][2:] == ("www.example.com/en/", "allow") and got[3][2:] == ("www.example.com/en/", "allow")
    assert got[4][2:] == ("net/es/", "block") and got[5][2:] == (None, "allow")
    assert got[10] == got[11] == ("", "", None, "allow")
    assert got[12][2:] == (None, "allow") and got[13] == ("com", "", None, "allow") and got[14][2:] == ("com/", "allow")
    assert got[8][2:] == (None, "allow") and got[9][2:] == (None, "allow")
    # foo.net/es/ is linked with an allowed URL, so its aliases are allowed; foo.net/fr/z is not.
    assert got[6][2:] == (None, "block") and got[7][2:] == (None, "block")
    assert got[15][3] == got[16][3] == got[17][3] == "allow" and got[18][2:] == ("com/", "allow")
    seen = spark.createDataFrame([("http://t.org/1", "http://foo.net/fr/q"), (None, "http://foo.net/fr/q")], "source_url string, target_url string")
    assert {r.verdict for r in url_filter.judge(spark.createDataFrame([(1, "http://t.org/1", "", "", "")], PAGES), redirects=seen).collect()} == {"block"}
    assert url_filter.judge(df.limit(0)).count() == 0


def test_urls_that_differ_in_the_query_are_two(spark):
    rows = [(1, "http://shop.org/item?id=1#top", '<link rel="canonical" href="http://foo.net/fr/q?x=/en/">'), (2, "http://shop.org/item?id=2", ""), (3, "http://shop.org/item", ""), (4, "https://shop.org/item?id=1", "")]
    rows += [(5, "http://other.org?u=/a", '<meta http-equiv="refresh" content="0; url=/item?id=1">'), (6, "http://other.org/item?id=1", '<link rel=canonical href="http://shop.org/item?id=1">')]
    got = {r.page_id: r.verdict for r in url_filter.judge(spark.createDataFrame([(*r, "x", "y") for r in rows], PAGES)).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "block"}


def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/code.py", "x = 1"), (3, "a/b/own.py", "hello\nLicensed under the Apache License, Version 2.0.\nbye"), (4, "c/none.py", "no rights here"),
        (5, "a/b/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."), (6, "a/b/c/d/deep.py", None), (7, None, "Released under the MIT License."),
        (8, "ab/near.py", ""), (9, "c/talk.py", "my driving license and the copyright of cows are dull and long subjects for a talk of an hour"), (9, "c/talk.py", "Licensed under CC BY-NC 4.0."),
    ]
    df = spark.createDataFrame([(*r, "l") for r in rows], "file_id long, path string, text string, license string")
    got = {(r.file_id): (r.license, r.source, r.directory) for r in license_scan.scan(df).collect()}
    assert got == {
        1: ("MIT", "own", None), 2: ("MIT", "inherited", "a"), 3: ("Apache-2.0", "own", None), 4: (None, None, None), 5: ("GPL-3.0", "own", None),
        6: ("GPL-3.0", "inherited", "a/b/c"), 7: ("MIT", "own", None), 8: (None, None, None), 9: ("CC-BY-NC-4.0", "own", None),
    }
    assert license_scan.scan(df).count() == len(rows) and license_scan.scan(df.limit(0)).count() == 0
    top = spark.createDataFrame([(1, "LICENSE", mit), (2, "x/y", "z")], "file_id long, path string, text string")
    assert {r.license for r in license_scan.scan(top).collect()} == {"MIT"}


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(60, 20), (3, 3), (None, 5)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{k: 7 for k in [7, *range(20, 61)]}}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_plans_of_native_operators_hold_no_python(spark):
    import __spark_entry__

    for name in ("op5_url_filter", "op10_license_scan"):
        plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
