import numpy as np

from codegauge.llm import minhash_dedup, near_dedup


def sets(text):
    words = text.encode().lower().split() if text else []
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """(n_shingles, component_id) of each row by comparing each two rows."""
    data = [sets(t) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = data[i], data[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    least = {}
    for c, (i, _) in zip(comp, rows):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return [(i, len(d), i if not d else least.get(c)) for (i, _), d, c in zip(rows, data, comp)]


def made(rng, families=25, members=12):
    """Families of edited copies; some copies of one member more."""
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(families):
        base = list(rng.choice(words, int(rng.integers(3, 120))))
        for _ in range(members):
            text = list(base)
            for _ in range(int(rng.integers(0, 4))):
                text[int(rng.integers(len(text)))] = str(rng.choice(words))
            rows.append(" ".join(text))
    return [*rows, *rows[:40:3], *[r.upper() for r in rows[:9:2]]]


def check(spark, rows, schema="doc_id long, text string, h int, kept string"):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], schema).repartition(4)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash_dedup.dedup_groups(docs).collect()), key=str)
    want = sorted(((*w, w[0] == w[2]) for w in brute(rows)), key=str)
    assert got == want
    return got


def test_groups_as_by_brute_force(spark):
    texts = made(np.random.default_rng(3))
    rng = np.random.default_rng(4)
    ids = rng.permutation(10 * len(texts))[: len(texts)].tolist()
    got = check(spark, list(zip(ids, texts)))
    assert 30 < sum(not k for *_, k in got) < len(got) - 25


def test_groups_of_several_lots(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "LOT", 4)
    monkeypatch.setattr(minhash_dedup, "HELD", 300)
    texts = made(np.random.default_rng(8), 6, 30)
    check(spark, list(enumerate(texts)))


def test_odd_rows(spark):
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " \n"), (4, text), (4, text), (2, text.upper()), (None, text), (None, None), (None, "only these words without an id"), (9, "few words"), (8, "few  words"), (7, "few word")]
    rows += [(100 + i, "long " * 30_000 + f"end {i // 2}") for i in range(4)]
    check(spark, rows)
    check(spark, [])


def test_minima_tell_the_similarity():
    rng = np.random.default_rng(0)
    both, a, b = (rng.integers(0, 1 << 64, n, np.uint64) for n in (1700, 150, 150))
    agree = (minhash_dedup.minima(np.append(both, a)) == minhash_dedup.minima(np.append(both, b))).mean()
    assert abs(agree - 0.85) < 0.13 and near_dedup.similar(np.sort(np.append(both, a)), np.sort(np.append(both, b)), 0.85)
