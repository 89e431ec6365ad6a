"""Documents to packed training sequences: quality rules, line dedup, near-dedup, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codegauge.llm import line_dedup, near_dedup, packing, quality_rules, shared, simhash_dedup, source_mix


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality_rules.kept_rows(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so does a document that lost every word that way."""
    return line_dedup.without_repeats(docs, drop_empty=True, whole=True, characters=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: fingerprints within two bits, by op3's pigeonring; then, of what is left, Jaccard similarity 0.8 or more of five-word shingles."""
    return near_dedup.keep_one(shared.written(simhash_dedup.keep_one(docs), "near-fingerprints"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return source_mix.mixed_rows(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the packed sequences."""
    return packing.pack(docs)


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_duplicates), ("source mix", mixture), ("best-fit packing", sequences)]

#: Hashes, convex optimisation and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
