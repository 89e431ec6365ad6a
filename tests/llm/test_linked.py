import numpy as np
from pyspark.sql import functions as F

from codegauge.llm import minhash
from codegauge.sources.store import settings


def test_links_every_similar_pair_that_shares_a_key(spark):
    rng = np.random.default_rng(8)
    value = rng.integers(0, 1200, 400).tolist()
    rows = {(int(rng.integers(0, 60)) if rng.random() < 0.5 else 1000 + int(rng.integers(0, 300)), h) for h in range(400) for _ in range(3)}
    rows |= {(77, h) for h in range(0, 400, 2)}  # a hot key
    by_key = {}
    for k, h in rows:
        by_key.setdefault(k, []).append(h)
    root = list(range(400))

    def find(h):
        while root[h] != h:
            h = root[h]
        return h

    for items in by_key.values():
        for a in items:
            for b in items:
                if abs(value[a] - value[b]) <= 2:
                    low, high = sorted((find(a), find(b)))
                    root[high] = low
    want = {h: find(h) for h in range(400)}
    linked = {r for r in want.values() if list(want.values()).count(r) > 1}
    keys = spark.createDataFrame([(k, h, 0) for k, h in rows for _ in range(1 + h % 2)], "k long, h long, x long")
    values = spark.createDataFrame(list(enumerate(value)), "h long, v long")

    def verified(pairs):
        assert pairs.where("a >= b").isEmpty()
        both = pairs.join(values.toDF("a", "va"), "a").join(values.toDF("b", "vb"), "b")
        return both.where(F.abs(F.col("va") - F.col("vb")) <= 2).select("a", "b")

    for batch in ("7", "10000"):
        with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch=batch):
            got = minhash.linked(minhash.shared_keys(keys), verified, lambda a, b: a == b)
            assert {r.h: r.component for r in got.collect()} == {h: c for h, c in want.items() if c in linked}


def test_lots_and_buckets_lose_no_item():
    rng = np.random.default_rng(3)
    k = np.concatenate([rng.integers(0, 1 << 64, 300, np.uint64)[rng.integers(0, 300, 900)], np.full(2000, 1 << 63, np.uint64)])
    h = np.concatenate([rng.integers(-9, 9, 900), rng.integers(-700, 700, 2000)])
    order = rng.permutation(len(k))
    k, h = k[order], h[order]
    parts, rows = {}, []
    for low in range(0, len(k), 400):
        for b in minhash._packed_lot(k[low : low + 400], h[low : low + 400], h[low : low + 400] * 2, 5):
            for bucket, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                values = np.frombuffer(blob, np.int64)
                if kind == minhash._DONE:
                    rows += [(*r, True) for r in values.reshape(-1, 5).tolist()]
                else:
                    assert 0 <= bucket < 5
                    parts.setdefault(bucket, []).append((kind == minhash._LEADS, values.reshape(-1, 3)))
    assert len(parts) == 5 and max(sum(len(p[1]) for p in x) for x in parts.values()) < 500
    rows += [tuple(r.values()) for x in parts.values() for b in minhash._shared_rows(x) for r in b.to_pylist()]
    want = {}
    for key, item in zip(k.view(np.int64).tolist(), h.tolist()):
        want.setdefault(key, set()).add(item)
    want = {key: items for key, items in want.items() if len(items) > 1}
    links, more = {}, {}
    for key, item, x, lead, lead_x, several in rows:
        assert x == 2 * item and lead_x == 2 * lead and {item, lead} <= want[key]
        links.setdefault(key, {}).setdefault(item, set()).add(lead)
        more.setdefault(key, set()).add(several)
    assert {key: set(items) for key, items in links.items()} == want
    for key, items in links.items():  # every item leads on to one that all of the key's items reach
        assert more[key] == ({True} if len(want[key]) > 2 else more[key])
        ends = set()
        for item in items:
            seen = {item}
            while new := set().union(*(items[i] for i in seen)) - seen:
                seen |= new
            ends.add(min(seen))
        assert len(ends) == 1
