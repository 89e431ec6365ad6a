import numpy as np
from pyspark.sql import functions as F

from codegauge.llm import knn


def test_repeats_of_the_query_do_not_prune_its_answers(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.integers(-5, 6, 3)]) for i in range(1, 500)] + [(0, [1000, 1000, 1000])] * 12
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = [(r.vec_id, r.score) for r in knn.top_k(df, F.col("vec_id") == 0, 4, pivots=500).orderBy("rank").collect()]
    want = sorted(((i, 1000 * sum(v)) for i, v in rows if i), key=lambda x: (-x[1], x[0]))[:4]
    assert got == want
    far = np.array([[1000.0, 1000, 1000], [0, 0, 0]])
    q, radius, count = np.array([[1000, 1000, 1000]]), np.array([0.0, 9.0]), np.array([12.0, 499.0])
    assert knn.needed_cells(q, far, radius, count, 4, 12).all() and not knn.needed_cells(q, far, radius, count, 4).all()
