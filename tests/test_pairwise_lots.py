"""Pairwise statistics in lots of values, held against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from codegauge.operators import stats, windows


def made():
    rng = np.random.default_rng(6)
    values = {"a": rng.normal(0, 1, 150).round(1), "b": rng.normal(0.4, 1, 120).round(1), "c": rng.integers(0, 3, 80) * 1.0, "d": np.array([9.0])}
    return {"m": values, "k": {"a": np.arange(40.0), "b": np.full(5, 7.0)}}


def frame(spark, made):
    rows = [(m, a, float(v)) for m, by in made.items() for a, vs in by.items() for v in vs] + [("m", "a", None), ("m", "b", float("nan"))]
    return spark.createDataFrame(rows, "metric string, author string, value double")


def test_u_delta_and_t_in_any_lots(spark):
    data = made()
    for lot in (4, 7, 10_000):
        got = {(r.metric, r.f1, r.f2): r for r in stats.pairwise(frame(spark, data), resamples=0, lot=lot).collect()}
        assert len(got) == 6 + 1
        for (m, f1, f2), r in got.items():
            x, y = data[m][f1], data[m][f2]
            u = sum((p > q) + (p == q) / 2 for p in x for q in y)
            assert (r.n1, r.n2, r.u) == (len(x), len(y), u) and r.delta == pytest.approx(2 * u / (len(x) * len(y)) - 1)
            v = np.concatenate([x, y])
            ties = sum(float(c) ** 3 - c for c in np.unique(v, return_counts=True)[1])
            assert r.p_u == pytest.approx(stats.mann_whitney_p(u, len(x), len(y), ties))
            if min(len(x), len(y)) > 1:
                assert r.t == pytest.approx((x.mean() - y.mean()) / np.sqrt(x.var(ddof=1) / len(x) + y.var(ddof=1) / len(y)))


def test_intervals_as_by_plain_resampling(spark):
    data = made()
    got = {lot: {(r.metric, r.f1, r.f2): r for r in stats.pairwise(frame(spark, data), resamples=1000, lot=lot).collect()} for lot in (6, 10_000)}
    for key in (("m", "a", "b"), ("m", "a", "c"), ("k", "a", "b"), ("m", "b", "d")):
        x, y = data[key[0]][key[1]], data[key[0]][key[2]]
        (v1, c1), (v2, c2) = (np.unique(s, return_counts=True) for s in (x, y))
        low, high = stats.cliffs_interval(v1, c1, v2, c2, 4000)
        for rows in got.values():
            assert rows[key].ci_lo == pytest.approx(low, abs=0.03) and rows[key].ci_hi == pytest.approx(high, abs=0.03)


def test_sums_before_rows(spark):
    rng = np.random.default_rng(2)
    rows = [("hot" if i % 3 else f"g{i % 7}", int(k), int(rng.integers(5))) for i, k in enumerate(rng.permutation(300))]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r.g, r.k): r.s for r in windows.before(df, ["g"], ["k"], "v", "s").collect()}
    assert got == {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    assert windows.before(df.where(F.lit(False)), ["g"], ["k"], "v", "s").count() == 0
