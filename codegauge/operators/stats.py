"""Statistics of paired and unpaired samples.

Samples are reduced to counts by distinct value in Spark; tests and resampling see those counts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas
from ..sources.store import written
from . import windows


def comparison_seed(baseline: str, language: str, metric: str, seed: int = schemas.SEED) -> int:
    """first 8 bytes of a SHA-256, so that an interval depends on its own comparison alone."""
    return int.from_bytes(hashlib.sha256(f"{seed}:{baseline}:{language}:{metric}".encode()).digest()[:8], "big")


#: Indexes, or counts of distinct values, that a resampler holds at a time.
DRAWS = 1 << 24


def bootstrap_interval(values: np.ndarray, counts: np.ndarray, seed: int, resamples: int = schemas.BOOTSTRAP_RESAMPLES) -> tuple[float, float]:
    """M3: 95% percentile interval of the mean of sum(counts) differences; NaN without values or resamples.

    Up to 20 distinct values a resample is one multinomial draw over them; beyond, indexes are drawn, at most 250 resamples and
    DRAWS indexes at a time, which gives the same draws as all at once. A sum(counts) above DRAWS is drawn over the distinct
    values again, in lots: the same distribution, in memory that grows with the distinct values alone.
    """
    n = int(counts.sum())
    if not n or resamples <= 0:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    if len(values) <= 20 or n > DRAWS:
        lot = max(DRAWS // len(values), 1)
        means = np.concatenate([rng.multinomial(n, counts / n, size=min(lot, left)) @ values / n for left in range(resamples, 0, -lot)])
    else:
        flat, lot = np.repeat(values, counts), max(min(250, DRAWS // n), 1)
        means = np.concatenate([flat[rng.integers(0, n, size=(min(lot, left), n))].mean(axis=1) for left in range(resamples, 0, -lot)])
    low, high = np.percentile(means, [2.5, 97.5])
    return float(low), float(high)


def paired_deltas(pairs: DataFrame, keys: list[str], resamples: int = schemas.BOOTSTRAP_RESAMPLES) -> DataFrame:
    """M2, M3: pairs (baseline, language, metric, a, b) to mean a, mean b, delta, interval and n.

    Only the counts of (key, difference) reach Python: a few for rates, however many pairs there are.
    """
    means = pairs.groupBy(*keys).agg(F.avg("a").alias("submission"), F.avg("b").alias("baseline_value"), F.avg(F.col("a") - F.col("b")).alias("delta"), F.count("*").alias("n"))
    counts = pairs.groupBy(*keys, (F.col("a") - F.col("b")).cast("double").alias("d")).agg(F.count("*").alias("k"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("d")
        who = [str(pdf[k].iloc[0]) for k in keys]
        low, high = bootstrap_interval(pdf["d"].to_numpy(), pdf["k"].to_numpy(), comparison_seed(*(who + [""] * 3)[:3]), resamples)
        return pd.DataFrame([[*(pdf[k].iloc[0] for k in keys), low, high]], columns=[*keys, "ci_lo", "ci_hi"])

    kinds = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return means.join(counts.groupBy(*keys).applyInPandas(run, f"{kinds}, ci_lo double, ci_hi double"), keys)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1.0 + num * d, 1.0 + num / c
            d, c = 1.0 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def welch(n1: float, m1: float, v1: float, n2: float, m2: float, v2: float) -> tuple[float, float]:
    """M4: t and its two-sided p from counts, means and sample variances; NaN where either is undefined."""
    if n1 < 2 or n2 < 2 or v1 / n1 + v2 / n2 <= 0:
        return math.nan, math.nan
    a, b = v1 / n1, v2 / n2
    t = (m1 - m2) / math.sqrt(a + b)
    df = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n2 - 1))
    return t, beta_cdf(df / 2, 0.5, df / (df + t * t))


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def welch_t(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """M4 as a Column: t alone."""
    return (m1 - m2) / F.sqrt(v1 / n1 + v2 / n2)


def rank_sums(values: DataFrame, pair: list[str], side: str, value: str) -> DataFrame:
    """M5, M6: for each pair of samples (side 1 or 2): n1, n2, u, delta and the tie term.

    Ranks are of distinct values with their counts, added up over ranges of values.
    """
    counts = values.groupBy(*pair, value).agg(F.count_if(F.col(side) == 1).alias("c1"), F.count_if(F.col(side) == 2).alias("c2"))
    n = F.col("c1") + F.col("c2")
    ranked = windows.before(counts.withColumn("n", n), pair, [value], "n", "rank").withColumn("rank", F.col("rank") + (n + 1) / 2)
    out = ranked.groupBy(*pair).agg(F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(F.col("c1") * F.col("rank")).alias("r1"), F.sum((n * n * n - n).cast("double")).alias("ties"))
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2
    delta = F.when((F.col("n1") > 0) & (F.col("n2") > 0), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(2 * u, F.col("n1") * F.col("n2")) - 1)))
    return out.select(*pair, "n1", "n2", u.alias("u"), delta.alias("delta"), "ties")


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """M5: two-sided p by the normal approximation with continuity and ties; 1 where all values are equal."""
    n = n1 + n2
    if n1 == 0 or n2 == 0 or n < 2:
        return math.nan
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, normal_tail(max(0.0, abs(u - n1 * n2 / 2) - 0.5) / math.sqrt(var)))


def cliffs_interval(v1: np.ndarray, c1: np.ndarray, v2: np.ndarray, c2: np.ndarray, resamples: int = 1000, seed: int = 42) -> tuple[float, float]:
    """M7: 95% percentile interval of Cliff's delta, both sides resampled by counts over the shared values."""
    n1, n2 = int(c1.sum()), int(c2.sum())
    if not n1 or not n2 or resamples <= 0:
        return math.nan, math.nan
    rng = np.random.default_rng(seed)
    grid = np.unique(np.concatenate([v1, v2]))
    p1, p2 = np.zeros(len(grid)), np.zeros(len(grid))
    p1[np.searchsorted(grid, v1)], p2[np.searchsorted(grid, v2)] = c1 / n1, c2 / n2
    out = np.empty(resamples)
    for k in range(resamples):
        a, b = rng.multinomial(n1, p1), rng.multinomial(n2, p2)
        below = np.cumsum(b) - b
        out[k] = (a @ (2 * below + b)) / (n1 * n2) - 1
    low, high = np.percentile(out, [2.5, 97.5])
    return float(low), float(high)


def wilcoxon_sums(pairs: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """M8: n of nonzero differences, W+ and W-, W, dominance (share of a > b; 0.5 with no difference) and the tie term."""
    d = F.round(F.col(a) - F.col(b), 12)
    diffs = pairs.select(*keys, d.alias("d"))
    nonzero = diffs.where("d <> 0").select(*keys, F.abs("d").alias("m"), (F.col("d") > 0).cast("int").alias("up"))
    counts = nonzero.groupBy(*keys, "m").agg(F.sum("up").alias("ups"), F.count("*").alias("n"))
    ranked = windows.before(counts, keys, ["m"], "n", "rank").withColumn("rank", F.col("rank") + (F.col("n") + 1) / 2)
    n = F.col("n")
    sums = ranked.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("ups") * F.col("rank")).alias("w_plus"), F.sum((F.col("n") - F.col("ups")) * F.col("rank")).alias("w_minus"), F.sum("ups").alias("ups"), F.sum((n * n * n - n).cast("double")).alias("ties"))
    out = pairs.select(*keys).distinct().join(sums, keys, "left")
    return out.select(*keys, F.coalesce("n", F.lit(0)).alias("n"), "w_plus", "w_minus", F.least("w_plus", "w_minus").alias("w"), F.coalesce(F.col("ups") / F.col("n"), F.lit(0.5)).alias("dominance"), "ties")


def wilcoxon_p(n: int, w: float, ties: float) -> float:
    """M8: two-sided p by the normal approximation with ties; 1 with no difference."""
    if not n:
        return 1.0
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return normal_tail((w - n * (n + 1) / 4) / math.sqrt(var)) if var > 0 else 1.0


#: Distinct values, and resamples, that a task of `pairwise` works on together.
VALUES, RESAMPLES = 4096, 50


def _value_lots(counts: DataFrame, lot: int) -> DataFrame:
    """(metric, lot, author, v, n): a metric's distinct values in order, `lot` of them to a lot."""
    grid = windows.before(counts.select("metric", "v", F.lit(1).alias("one")).distinct(), ["metric"], ["v"], "one", "rank")
    return counts.join(grid.select("metric", "v", F.floor(F.col("rank") / lot).cast("int").alias("lot")), ["metric", "v"])


def _pair_lots(cells: DataFrame) -> DataFrame:
    """(metric, lot, f1, f2, c1, c2, n1, n2, twice_u, ties): both authors' counts of a lot's values, and what they add to U twice over and to the ties."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.unique(pdf["v"].to_numpy())
        by = {}
        for author, part in pdf.groupby("author"):
            by[author] = np.zeros(len(values), np.int64)
            by[author][np.searchsorted(values, part["v"].to_numpy())] = part["n"].to_numpy()
        rows = []
        for f1 in sorted(by):
            for f2 in sorted(by):
                if f1 < f2:
                    rows.append((f1, f2, by[f1], by[f2]))
        rows += [(f1, None, by[f1], None) for f1 in by]  # for a lot in which the other author has no value
        out = [(pdf["metric"].iloc[0], pdf["lot"].iloc[0], f1, f2, a, b, a.sum(), None if b is None else b.sum(), None if b is None else _twice_u(a, b), _ties(a if b is None else a + b)) for f1, f2, a, b in rows]
        return pd.DataFrame(out, columns=["metric", "lot", "f1", "f2", "c1", "c2", "n1", "n2", "twice_u", "ties"])

    return cells.groupBy("metric", "lot").applyInPandas(run, "metric string, lot int, f1 string, f2 string, c1 array<long>, c2 array<long>, n1 long, n2 long, twice_u double, ties double")


def _twice_u(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Twice the pairs in which a is greater, ties counting half; along the last axis, which is in order of values."""
    b = b.astype(np.float64)
    return (a * (2 * np.cumsum(b, axis=-1) - b)).sum(axis=-1)


def _ties(n: np.ndarray) -> float:
    n = n.astype(np.float64)
    return float((n**3 - n).sum())


def _all_lots(lots: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each pair of authors and each lot in which either has a value; empty counts for one that has none."""
    alone = lots.where("f2 is null").select("metric", "lot", F.col("f1").alias("author"), F.col("c1").alias("c"), F.col("n1").alias("n"), "ties")
    sides = [alone.select("metric", "lot", F.col("author").alias(f"f{i}"), F.col("c").alias(f"c{i}"), F.col("n").alias(f"n{i}"), F.col("ties").alias(f"ties{i}")) for i in (1, 2)]
    both = pairs.join(sides[0], ["metric", "f1"], "left").where("lot is not null")
    one = both.join(lots.where("f2 is not null").select("metric", "lot", "f1", "f2"), ["metric", "lot", "f1", "f2"], "left_anti")
    two = pairs.join(sides[1], ["metric", "f2"]).join(lots.where("f2 is not null").select("metric", "lot", "f1", "f2"), ["metric", "lot", "f1", "f2"], "left_anti")
    none, zero = F.lit(None).cast("array<bigint>"), F.lit(0).cast("long")
    one = one.select("metric", "lot", "f1", "f2", "c1", none.alias("c2"), "n1", zero.alias("n2"), F.lit(0.0).alias("twice_u"), F.col("ties1").alias("ties"))
    two = two.select("metric", "lot", "f1", "f2", none.alias("c1"), "c2", zero.alias("n1"), "n2", F.lit(0.0).alias("twice_u"), F.col("ties2").alias("ties"))
    return lots.where("f2 is not null").select(*one.columns).unionByName(one).unionByName(two)


def cliffs_resamples(lots: DataFrame, resamples: int, seed: int = schemas.SEED) -> DataFrame:
    """M7: (metric, f1, f2, ci_lo, ci_hi), the 95% percentile interval of Cliff's delta, both sides resampled by counts of values.

    lots: a row (metric, f1, f2, lot, c1, c2, n1, n2) for each pair and lot of values. First the lots' shares of each resample are drawn,
    then each lot's counts given its share: together a draw over all values. Each has a generator of its own, seeded by the
    pair, the lot and the number of the first resample, so results do not depend on how rows are dealt.
    """
    spark = lots.sparkSession
    pair = ["metric", "f1", "f2"]
    shares = lots.groupBy(*pair).agg(F.array_sort(F.collect_list(F.struct("lot", "n1", "n2"))).alias("lots"))  # small: a share for each lot
    shares = shares.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1), F.lit(RESAMPLES))))

    def seeded(*key: object) -> np.random.Generator:
        return np.random.default_rng(int.from_bytes(hashlib.sha256(":".join(map(str, (seed, *key))).encode()).digest()[:8], "big"))

    def parts(rng: np.random.Generator, n: int | np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
        total = counts.sum()
        return rng.multinomial(n, counts / total, size=size) if total else np.zeros((size, len(counts)), np.int64)

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for metric, f1, f2, lots, first in zip(*(pdf[c] for c in (*pair, "lots", "first"))):
                n1, n2 = (np.array([x[k] for x in lots], np.int64) for k in ("n1", "n2"))
                size, rng = min(RESAMPLES, resamples - first), seeded(metric, f1, f2, first)
                a, b = parts(rng, int(n1.sum()), n1, size), parts(rng, int(n2.sum()), n2, size)
                yield pd.DataFrame({"metric": metric, "f1": f1, "f2": f2, "first": first, "lot": [x["lot"] for x in lots], "a": list(a.T), "b": list(b.T), "below": list((np.cumsum(b, axis=1) - b).T)})

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                rng, a, b = seeded(r.metric, r.f1, r.f2, r.first, r.lot), np.asarray(r.a), np.asarray(r.b)
                twice = 2.0 * a * np.asarray(r.below)
                if r.c1 is not None and r.c2 is not None:
                    c1, c2 = np.asarray(r.c1), np.asarray(r.c2)
                    twice += _twice_u(parts(rng, a, c1, len(a)), parts(rng, b, c2, len(b)))
                out.append(twice)
            yield pd.DataFrame({**{c: pdf[c] for c in (*pair, "first")}, "twice": out})

    kinds = "metric string, f1 string, f2 string, first int"
    shares = shares.repartition(*pair, "first").mapInPandas(drawn, f"{kinds}, lot int, a array<long>, b array<long>, below array<long>")
    # Few rows that are dear: as many partitions as the session's shuffles have, which are not put together again.
    rows = shares.join(lots.select(*pair, "lot", "c1", "c2"), [*pair, "lot"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *pair, "lot", "first")
    twice = rows.mapInPandas(inside, f"{kinds}, twice array<double>")
    twice = twice.select(*pair, "first", F.posexplode("twice").alias("i", "t")).groupBy(*pair, "first", "i").agg(F.sum("t").alias("t"))
    sizes = lots.groupBy(*pair).agg((F.sum("n1").cast("double") * F.sum("n2")).alias("nn"))
    deltas = twice.join(sizes, pair).withColumn("delta", F.col("t") / F.col("nn") - 1)
    return deltas.groupBy(*pair).agg(F.percentile("delta", 0.025).alias("ci_lo"), F.percentile("delta", 0.975).alias("ci_hi"))


def pairwise(samples: DataFrame, metric: str = "metric", author: str = "author", value: str = "value", resamples: int = 1000, lot: int = VALUES) -> DataFrame:
    """Each pair of authors of each metric: Welch t, U, delta with interval, p and q (families kept apart).

    samples (metric, author, value), null values left out. Authors sort by name; delta > 0 means the first tends to be larger. Without
    resamples there is no interval. A metric's values are cut into lots, which are compared and resampled each by itself: no task
    holds a metric's values, or more than RESAMPLES draws of a lot.
    """
    named = samples.select(F.col(metric).cast("string").alias("metric"), F.col(author).cast("string").alias("author"), F.col(value).cast("double").alias("v"))
    counts = written(named.where("v is not null and not isnan(v)").groupBy("metric", "author", "v").agg(F.count("*").alias("n")), "sample-counts")
    means = counts.groupBy("metric", "author").agg(F.sum("n").alias("n"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("m"))
    spread = F.sum(F.col("n_v") * (F.col("v") - F.col("m")) ** 2) / F.greatest(F.lit(1), F.max("n") - 1)
    moments = counts.withColumnRenamed("n", "n_v").join(means, ["metric", "author"]).groupBy("metric", "author").agg(F.max("n").alias("n"), F.max("m").alias("m"), spread.alias("s"))
    moments = written(moments, "sample-moments")
    side = lambda i: moments.select("metric", F.col("author").alias(f"f{i}"), *[F.col(c).alias(f"{c}{i}") for c in ("n", "m", "s")])
    pairs = side(1).join(side(2), "metric").where("f1 < f2")  # of authors

    lots = written(_pair_lots(_value_lots(counts, lot)), "pair-lots")
    lots = written(_all_lots(lots, pairs.select("metric", "f1", "f2")), "pair-lots")
    below = Window.partitionBy("metric", "f1", "f2").orderBy("lot").rowsBetween(Window.unboundedPreceding, -1)  # over lots
    twice = lots.drop("c1", "c2").withColumn("t", F.col("twice_u") + 2.0 * F.col("n1") * F.coalesce(F.sum("n2").over(below), F.lit(0)))
    sums = twice.groupBy("metric", "f1", "f2").agg((F.sum("t") / 2).alias("u"), F.sum("ties").alias("ties"))

    def tested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["t"], pdf["p_t"] = zip(*(welch(*x) for x in zip(*(pdf[c] for c in ("n1", "m1", "s1", "n2", "m2", "s2"))))) if len(pdf) else ([], [])
            pdf["p_u"] = [mann_whitney_p(*x) for x in zip(pdf["u"], pdf["n1"], pdf["n2"], pdf["ties"])]
            pdf["delta"] = (2 * pdf["u"] / (pdf["n1"] * pdf["n2"]) - 1).clip(-1.0, 1.0)
            yield pdf[["metric", "f1", "f2", "n1", "n2", "t", "p_t", "u", "p_u", "delta"]]

    out = pairs.join(sums, ["metric", "f1", "f2"]).mapInPandas(tested, "metric string, f1 string, f2 string, n1 long, n2 long, t double, p_t double, u double, p_u double, delta double")
    if resamples > 0:
        out = out.join(cliffs_resamples(lots, resamples), ["metric", "f1", "f2"])
    else:
        out = out.withColumns({"ci_lo": F.lit(None).cast("double"), "ci_hi": F.lit(None).cast("double")})
    out = written(out.withColumn("p_t", F.when(~F.isnan("p_t"), F.col("p_t"))).withColumnRenamed("metric", metric), "pairwise")
    return windows.benjamini_hochberg(windows.benjamini_hochberg(out, "p_t").withColumnRenamed("q", "q_t"), "p_u").withColumnRenamed("q", "q_u")
