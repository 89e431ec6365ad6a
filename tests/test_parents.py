import random
import time

from codegauge.operators import joins


def brute(rows):
    out = {}
    for f, i, s, e in rows:
        holds = [(b - a, j) for g, j, a, b in rows if g == f and a <= s and b >= e and (a, b) != (s, e)]
        out[f, i] = min(holds)[1] if holds else None
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id string, idx int, start int, end int").repartition(4)


def test_parents_as_by_brute_force(spark):
    rng = random.Random(3)
    for n, width in ((5, 6), (40, 12), (120, 60)):
        rows = [(rng.choice("abc"), i, s := rng.randrange(width), s + rng.randrange(width)) for i in range(n)]
        got = {(r.row_id, r.idx): r.parent for r in joins.parents(frame(spark, rows)).collect()}
        assert got == brute(rows)
    assert joins.parents(frame(spark, rows).limit(0)).count() == 0


def test_one_file_in_several_ranges(spark):
    rng = random.Random(9)
    rows = [("hot", i, s := rng.randrange(500), s + rng.choice([1, 3, 40, 400])) for i in range(600)] + [("cold", 0, 0, 5), ("cold", 1, 1, 5), ("cold", 2, 1, 5)]
    got = {(r.row_id, r.idx): r.parent for r in joins.parents(frame(spark, rows)).collect()}
    assert got == brute(rows)


def test_many_spans_in_one_file(spark):
    n = 100_000
    spans = spark.range(n).selectExpr("'f' as row_id", "cast(id as int) as idx", "cast(id as int) as start", f"cast(if(id % 10 = 0, id + 9, id) as int) as end")
    begin = time.perf_counter()
    got = joins.parents(spans).selectExpr("count(*) as n", "count_if(idx % 10 = 0 and parent is null) as tops", "count_if(idx % 10 > 0 and parent = idx - idx % 10) as inner").first()
    assert tuple(got) == (n, n // 10, n - n // 10) and time.perf_counter() - begin < 60


def test_primary_functions(spark):
    rows = [("r1", "human", 1, 0), ("r1", "human", 0, 5), ("r1", "human", 0, 2), (None, "human", 0, 1), ("r2", "model", 0, 1)]
    df = spark.createDataFrame(rows, "row_id string, author string, function_index int, at int")
    got = sorted(map(tuple, joins.primary(df, ["row_id", "author"], order=["at"]).collect()))
    assert got == [("r1", "human", 0, 2), ("r2", "model", 0, 1)]
