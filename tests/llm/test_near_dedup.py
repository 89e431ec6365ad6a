import numpy as np

import corpus_pipeline
from codegauge.llm import near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def jaccard(a, b):
    a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_pipeline_removes_edited_copies(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(4000)]
    rows, near = [], 0
    for i in range(150):
        base = list(rng.choice(words, 200))
        rows.append((i, " ".join(base)))
        edited = list(base)
        for _ in range(1 + i % 4):
            edited[int(rng.integers(200))] = str(rng.choice(words))
        rows.append((1000 + i, " ".join(edited)))
        near += jaccard(rows[-2][1], rows[-1][1]) >= 0.8
    far = list(rng.choice(words, 200))
    rows.append((5000, " ".join(far)))
    rows.append((5001, " ".join(far[:100] + list(rng.choice(words, 100)))))
    rows += [(6000, None), (6001, ""), (None, rows[0][1]), (None, "some words that nobody else has written so far")]
    docs = spark.createDataFrame([(*r, "en", "a", 1, "x") for r in rows], SCHEMA)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    left = sorted(r.doc_id for r in got.collect() if r.doc_id is not None)
    gone = sum(1000 <= i < 2000 for i in (r[0] for r in rows) if i is not None) - sum(1000 <= i < 2000 for i in left)
    assert near > 140 and 0.99 * near <= gone <= near  # recall on pairs of Jaccard 0.8 or more; none below goes
    assert [i for i in left if i < 1000] == list(range(150)) and [i for i in left if i >= 5000] == [5000, 5001, 6000]
    assert sum(r.doc_id is None for r in got.collect()) == 1 and got.columns == docs.columns
    assert near_dedup.keep_one(docs.limit(0)).count() == 0
