from pyspark.sql import functions as F

from codegauge.operators import stats
from codegauge.plans import queries


def test_pairwise_query_takes_values_as_they_are(spark, tmp_path):
    rows = [(k, 1 + k % 3, ("click", "view")[k % 2], (k * 37 % 101) / 1000) for k in range(200)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    events.write.parquet(f"{tmp_path}/events.parquet")
    (got,) = queries.QUERIES["pairwise_statistics"](spark, str(tmp_path)).collect()
    click, view = ([r[3] for r in rows if r[2] == x] for x in ("click", "view"))
    assert got.u == sum((a > b) + (a == b) / 2 for a in click for b in view)
    samples = events.select(F.lit("value").alias("metric"), F.col("event_type").alias("author"), "value")
    (want,) = stats.pairwise(samples, resamples=1000).collect()
    assert (got.ci_lo, got.ci_hi) == (want.ci_lo, want.ci_hi)
