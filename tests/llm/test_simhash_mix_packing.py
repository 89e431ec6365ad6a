import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from codegauge.llm import packing, simhash_dedup, source_mix, tokens

DOCS = "doc_id long, text string, lang string, source string, fp string, size long, copies int"
NEAR = " ".join(f"w{i}" for i in range(400))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "x", 1, 2) for i, t, s in rows], DOCS)


def sample(spark):
    texts = [None, "", "  \n\t ", "one", "one two", NEAR, NEAR, NEAR.upper(), NEAR + " end", "é ü ß 日本 x", "a b c d e f g " * 50]
    rows = [(i, t, ("s1", "s2", None)[i % 3]) for i, t in enumerate(texts)]
    return table(spark, [*rows, rows[5], (None, NEAR, None), (None, "unlike all the others here", "s1")])


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " ", "One", "one TWO", "a b c", "É é A b c d", "x y " * 40_000])
def test_fingerprint(text):
    assert simhash_dedup.fingerprint(text) == brute_fingerprint(text)


def test_links_find_every_pair(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    fps = {0, (1 << 64) - 1, *base.tolist()}
    for b in base.tolist():
        for _ in range(6):
            fps.add(b ^ sum({1 << int(k) for k in rng.integers(0, 64, rng.integers(1, 4))}))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {tuple(r) for r in simhash_dedup.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a != b and (a ^ b).bit_count() <= 2}
    assert got == want and want


def test_dedup_groups_and_keeper(spark):
    docs = sample(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = parent[i], parent[j]
                parent = [b if p == a else p for p in parent]
    least = {p: min((rows[i][0] for i in range(len(rows)) if parent[i] == p and rows[i][0] is not None), default=None) for p in set(parent)}
    got = Counter((r.doc_id, r.component_id) for r in simhash_dedup.dedup_groups(docs).collect())
    assert got == Counter((rows[i][0], least[parent[i]]) for i in range(len(rows)))
    kept = simhash_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert len(out) == len(least) and Counter(r.doc_id for r in out) == Counter(least.values())
    assert simhash_dedup.dedup_groups(docs.limit(0)).count() == 0 and simhash_dedup.keep_one(docs.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(["w"] * int(rng.pareto(1.2) * 20 + 1)), ["a", "b", "B", "", None, "z"][int(rng.choice(6, p=[0.5, 0.2, 0.1, 0.1, 0.05, 0.05]))]) for i in range(1500)]
    rows += [(5000, None, "a"), (5001, "", None), rows[0], (None, "p q r", "b")]
    docs = table(spark, rows)
    got = source_mix.mix(docs).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len((t or "").split())
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight, capped = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and level * weight[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.taken == r.copies * r.size and 0 <= r.copies <= 3
        assert r.target == pytest.approx(3 * size[r.source] if r.source in capped else level * weight[r.source])
    for s in order:
        target = 3 * size[s] if s in capped else level * weight[s]
        assert abs(taken[s] - target) <= 0.02 * target + 20, s
    again = source_mix.mix(docs).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))
    mixed = source_mix.mixed_rows(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert source_mix.mix(docs.limit(0)).count() == 0 and source_mix.mixed_rows(docs.limit(0)).count() == 0


def test_mix_without_words(spark):
    got = source_mix.mix(table(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.size, r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40))
def test_plan_uses_each_piece_once(lengths):
    counts = np.zeros(65, np.int64)
    for k, v in lengths.items():
        counts[k] = v
    used = Counter()
    for pattern, m in packing.plan(counts, 64):
        assert m > 0 and sum(x * k for x, k in pattern) <= 64
        for x, k in pattern:
            used[x] += k * m
    assert used == Counter(lengths)


def test_plan_prefers_exact_complements():
    counts = np.zeros(1025, np.int64)
    counts[[1000, 24, 900, 100, 24, 700, 200, 100, 24]] = 3
    counts[[700, 200, 100, 24, 1000]] = 2, 2, 4, 4, 2
    counts[900] = 2
    plans = packing.plan(counts)
    assert sum(m for _, m in plans) == 6  # (1000, 24), (900, 100, 24), (700, 200, 100, 24): the last by best fit


def test_pack_is_gapless_and_whole(spark):
    rows = [(i, t, "s") for i, t in enumerate([None, "", "x", "hello world " * 900, NEAR, NEAR, "é　  日本 <|endoftext|> end\n", "y" * 5000])]
    docs = table(spark, [*rows, rows[3], (None, "no id", "s")])
    got = packing.pack(docs).collect()
    path = tokens.vocabulary_path()
    want = Counter()
    for r in docs.collect():
        ids = tokens.brute_ids([r.text], path)[0] + b"\2\0\0\0"
        n = len(ids) // 4
        first = n if n <= 1024 else n % 1024 or 1024
        cuts = [0, *range(first, n + 1, 1024)]
        for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for s in {r.sequence_id for r in got}:
        end = 0
        for r in sorted((r for r in got if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    assert packing.pack(docs.limit(0)).count() == 0


PARTS = st.sampled_from([" ", "  ", "\n", "\t", "a", "é", "b.", "!!", "'s", "12", " ", "　", "日本", "<|endoftext|>", "\x1c", "\x85", "\r\n", "z" * 300, " y", "ñ "])


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=14).map("".join) | st.none(), max_size=6))
def test_chunked_ids_are_the_library_s(texts):
    path = tokens.vocabulary_path()
    ids, n = tokens.encoder(path).ids_of(texts)
    ends = np.cumsum(n)
    assert [ids[e - k : e].astype("<u4").tobytes() for e, k in zip(ends, n)] == tokens.brute_ids(texts, path)


def test_encoder_forgets_and_goes_on():
    path = tokens.vocabulary_path()
    small = tokens.ChunkEncoder(path, keep=50)
    texts = [" ".join(f"tok{i}x{j}" for j in range(40)) for i in range(60)]
    total = np.zeros(small.size, np.int64)
    small.count_ids([[t] for t in texts], total)
    want = np.concatenate([np.frombuffer(b, "<u4") for b in tokens.brute_ids(texts, path)])
    assert (total == np.bincount(want, minlength=small.size)).all()
