import corpus_pipeline
from codegauge.llm import simhash_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string"


def test_near_fingerprints_are_linked_too(spark):
    """Two texts within two bits of a fingerprint whose five-word shingles have a similarity below 0.8, and one far from both."""
    base = [f"w{i % 7}" for i in range(700)]
    near = list(base)
    near[300:300] = ["new"]
    near[350:350] = ["more"]
    shingles = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    assert len(shingles(base) & shingles(near)) < 0.8 * len(shingles(base) | shingles(near))
    texts = [" ".join(base), " ".join(near), " ".join(f"x{i}" for i in range(60))]
    fps = [simhash_dedup.fingerprint(t) for t in texts]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 < (fps[0] ^ fps[2]).bit_count()
    docs = spark.createDataFrame([(i, t, "en", "a", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [0, 2]
