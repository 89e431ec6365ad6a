"""Near-duplicate documents by the Jaccard similarity of their word shingles: the pipeline's stage.

The way is that of `minhash_dedup`, at five-word shingles and a similarity of 0.8: every link is confirmed on the whole sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import minhash_dedup
from .minhash_dedup import shingles, similar  # noqa: F401

SHINGLE, SIMILARITY = 5, 0.8


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near copies left, all columns as they were: a row with the group's least doc_id.

    Null and empty texts are one group. Rows that share a doc_id are one document: of them one stays. A group in which every
    doc_id is null keeps one of its rows; other rows with a null doc_id go. An empty table gives no rows.
    """
    return minhash_dedup.keep_one(docs, shingle, similarity)
