import hashlib
import random

from codegauge.llm import periodic_runs, queries


def brute(words, exponent=2, least=2):
    """All maximal stretches by trying each period from each place."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j - i >= p:
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((a, b - a, p) for (a, b), p in found.items() if b - a >= max(least, exponent * p))


def made(rng):
    words = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 6])) for _ in range(rng.randint(0, 40))]
    if rng.random() < 0.5 and words:
        part = words[: rng.randint(1, 6)]
        words = words + part * rng.randint(1, 6) + [b"x"] + words[:7] + part * 3
    return words * rng.choice([1, 1, 1, 2, 3])


def test_all_runs_as_by_brute_force():
    rng = random.Random(5)
    for _ in range(300):
        texts = [made(rng) for _ in range(rng.randint(1, 6))]
        assert periodic_runs.runs_of(texts) == [brute(t) for t in texts]
        assert periodic_runs.runs_of(texts, 4, 6) == [brute(t, 4, 6) for t in texts]


def test_one_long_text():
    words = [b"a", b"b", b"c"] * 20_000
    assert periodic_runs.runs_of([words]) == [[(0, 60_000, 3)]]
    words = [b"%d" % (i * i % 1009) for i in range(5000)] + [b"z"] * 5000
    assert (5000, 5000, 1) in periodic_runs.runs_of([[], words])[1]


def test_collapsed_rows(spark):
    texts = ["to be " * 5 + "or not", None, "", " \n\t", "no run here", "x " * 40, "a b " * 8]
    rows = [(i, t, "en", 1) for i, t in enumerate(texts)] + [(None, "x " * 40, None, None), (0, texts[0], "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs string, collapsed int")
    got = sorted(periodic_runs.collapsed(docs).collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    assert [r.doc_id for r in got] == [0, 0, 1, 2, 3, 4, 5, 6, None]
    assert [[tuple(x) for x in r.runs] for r in got] == [[(0, 10, 2)]] * 2 + [[]] * 4 + [[(0, 40, 1)], [(0, 8, 1)], [(0, 40, 1)]]
    assert [r.collapsed for r in got] == ["to be or not"] * 2 + ["", "", "", "no run here", "x", "a b", "x"]
    assert got[2].collapsed_sha256 == hashlib.sha256(b"").hexdigest() == got[2].runs_sha256
    assert got[0].runs_sha256 == hashlib.sha256(b"0,10,2\n").hexdigest()
    assert periodic_runs.collapsed(docs.limit(0)).count() == 0


def test_query_over_texts_without_words(spark, tmp_path):
    texts = ["", " \n\t", None, "one", "to be or not"]
    docs = spark.createDataFrame([(i, texts[i % 5]) for i in range(100)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()}
    nothing = hashlib.sha256(b"").hexdigest()
    assert sorted(got) == list(range(100))
    assert all((r.n_runs, r.start, r.runs_sha256) == (0, None, nothing) and (r.collapsed_sha256 == nothing) == (i % 5 < 3) for i, r in got.items() if i % 5 < 4)
