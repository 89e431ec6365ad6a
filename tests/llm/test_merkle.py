import hashlib
import random

from pyspark.sql import functions as F

from codegauge.llm import merkle


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 3])) for i in range(0, len(levels[-1]), 3)])
    return levels


def way(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 3 : i - i % 3 + 3]
        out.append((i % 3, run[: i % 3] + run[i % 3 + 1 :]))
        i //= 3
    return out


def fold(own, steps):
    for i, others in steps:
        own = h("".join(others[:i] + [own] + others[i:]))
    return own


def brute(rows, changed):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    trees, members = [], []
    for s in sources:
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        members.append(mine)
        trees.append(tree([leaf_of(r) for r in mine]))
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (mine, t) in enumerate(zip(members, trees)):
        for i, r in enumerate(mine):
            steps = way(t, i) + way(top, k)
            folded = fold(leaf_of((*r[:4], changed(r))), steps)
            out.append((r[0], leaf_of(r), t[-1][0], top[-1][0], h("".join("".join(x) for _, x in steps)), folded, folded == top[-1][0]))
    return out


NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, leaf string, root int"


def check(spark, rows, **how):
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA).repartition(5)
    got = merkle.verified(docs, F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")), **how)
    want = brute(rows, lambda r: r[4].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 and r[4] is not None else r[4])
    assert sorted(map(str, (tuple(r[n] for n in NAMES) for r in got.collect()))) == sorted(map(str, want))
    return want


def test_proofs_as_by_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for source, n in ((None, 4), ("", 1), ("a", 9), ("é", 28), ("z", 3), ("=", 10), ("B", 2)):
        rows += [(rng.randrange(1000), source, rng.choice(["en", None]), rng.choice([1, None, -5]), rng.choice([None, "", "x\ny", "näher\n\n", "plain"])) for _ in range(n)]
    rows += [(None, "a", None, None, None), (None, "a", None, None, None), rows[6], rows[6], rows[6]]
    want = check(spark, rows)
    assert {w[-1] for w in want} == {True, False}


def test_more_levels_than_one_pass_holds(spark):
    check(spark, [(i, "hot" if i % 3 else f"s{i % 40}", "en", i, f"line {i}\nmore") for i in range(400)], height=2)


def test_empty_and_single(spark):
    check(spark, [])
    check(spark, [(7, "a", None, 1, "alone\n")])
    check(spark, [(i, f"s{i}", None, 1, "alone") for i in range(20)])
