import numpy as np
from pyspark.sql import functions as F

from codegauge.llm import knn


def clustered(spark, n=2000):
    rng = np.random.default_rng(7)
    centre = rng.normal(0, 1, (25, 16))
    centre = 1000 * centre / np.linalg.norm(centre, axis=1)[:, None]
    rows = [(i, [int(x) for x in centre[i % 25] + rng.normal(0, 15, 16)]) for i in range(n)]
    return rows, spark.createDataFrame([(i, v, i % 50 == 0) for i, v in rows], "vec_id long, v array<long>, asks boolean")


def test_fewer_cells_than_all_are_searched(spark):
    rows, df = clustered(spark)
    cells = knn.Cells(df, 64, 16_384)
    near = knn._k_best(cells.solved(cells.first(10), 10, 64), 10)
    known = near.where("rank = 10").select("query_id", F.col("score").cast("double").alias("least"))
    searched = [len(r.cells) for r in cells.needed(known, 10).collect()]
    assert len(searched) == 40 and len(cells.centre) > 30
    assert np.mean(searched) < 0.25 * len(cells.centre)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in knn.top_k(df, F.col("asks"), 10, pivots=64, slice_rows=30).collect()}
    x = np.array([v for _, v in rows])
    for q in range(0, 2000, 50):
        best = sorted(((-int(s), i) for i, s in enumerate(x @ x[q]) if i != q))[:10]
        assert [got[q, n] for n in range(1, 11)] == [(i, -s) for s, i in best]


def test_empty_vectors_score_nothing(spark):
    df = spark.createDataFrame([(i, []) for i in range(5)], "vec_id long, v array<long>")
    got = [(r.query_id, r.vec_id, r.score) for r in knn.top_k(df, F.col("vec_id") == 3, 3).orderBy("rank").collect()]
    assert got == [(3, 0, 0), (3, 1, 0), (3, 2, 0)]


def test_equal_rows_of_one_id_lie_in_several_slices(spark):
    df = spark.createDataFrame([(7, [1, 2], False)] * 500 + [(1, [3, 4], True)], "vec_id long, v array<long>, asks boolean").repartition(4)
    cells = knn.Cells(df, 4, 50)
    assert cells.slices.where("vec_id = 7").groupBy("cell", "s").count().agg(F.max("count")).first()[0] < 120
    assert knn.top_k(df, F.col("asks"), 600, slice_rows=50).count() == 500
