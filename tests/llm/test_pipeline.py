import os
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from codegauge.llm import line_dedup, packing, quality_rules, simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"
WORDS = [a + b + c for a in "bcdfg" for b in "aeiou" for c in ("lm", "rt", "nk", "st")]


def prose(seed, n=60):
    return " ".join(WORDS[(seed * 31 + k * (7 + seed % 5) + k * k * seed) % len(WORDS)] for k in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows = [(i, prose(i), "en", "abc"[i % 3]) for i in range(60)]
    rows += [(100 + i, prose(i), "en", "a") for i in range(5)]  # exact copies
    rows += [(200, prose(3) + "\n" + prose(77), "en", "b"), (201, None, "en", None), (202, "", "en", "c"), (203, "$# " * 80, "en", "a"), (204, prose(90, 3000), "en", "b")]
    path = str(tmp_path_factory.mktemp("docs"))
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    return path


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    (_, quality), (_, lines), (_, near), (_, mix), (_, pack) = corpus_pipeline.STAGES
    a = quality(spark, docs, folder)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {i for i, t in rows.items() if quality_rules.first_rejection(quality_rules.Text(t), quality_rules.RULES) is None}
    assert {r.doc_id for r in a.collect()} == kept and a.columns == docs.columns
    b = lines(spark, a, folder)
    seen, want = set(), {}
    for i in sorted(kept):
        out = []
        for x in rows[i].split("\n"):
            words = tuple(line_dedup.normal_words(x.encode()))
            if len(words) < line_dedup.MIN_WORDS or words not in seen:
                out.append(x)
            seen.add(words)
        if "\n".join(out).split():
            want[i] = "\n".join(out)
    assert {r.doc_id: r.text for r in b.collect()} == want and b.columns == docs.columns
    c = near(spark, b, folder)
    groups = defaultdict(list)
    fp = {i: simhash_dedup.fingerprint(t) for i, t in want.items()}
    for i in sorted(want):
        groups[next((g for g in groups if any((fp[i] ^ fp[j]).bit_count() <= 2 for j in groups[g])), i)].append(i)
    assert {r.doc_id for r in c.collect()} == set(groups) and c.columns == docs.columns
    d = mix(spark, c, folder)
    copies = Counter(r.doc_id for r in d.collect())
    assert set(copies) <= set(groups) and max(copies.values()) <= 3 and d.columns == docs.columns
    got = pack(spark, d, folder).collect()
    assert Counter((r.doc_id) for r in got if r.piece == 0) == copies
    assert all(r.offset + r.length <= packing.CAPACITY for r in got)


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_empty(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert os.path.isdir(tmp_path)
