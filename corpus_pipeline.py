"""From raw documents to packed training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lurescan.llm import decontaminate, packing, pii, quality, simhash
from lurescan.llm.text import stored, table


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    NULL and empty texts are scored as empty ones; equal texts, repeated rows among them, stay or go together;
    rows without doc_id are scored like any other. All columns stay.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the row with the smallest doc_id.

    Texts without words, NULL among them, are near copies of each other. Of repeated rows one stays. All
    columns stay.
    """
    return simhash.without_copies(docs, shingle=3, distance=2)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, those with a passage of an item without id as well.

    NULL and empty texts stay; repeated rows stay or go together. All columns stay.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"), window=10)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind, and ``n_chars`` counted again.

    NULL texts stay NULL, empty ones empty; repeated rows give the same text. No row goes.
    """
    return pii.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the documents that are left, with the token ids of each piece.

    A NULL or empty text is the end id alone. Repeated rows and rows without doc_id are packed each; no
    documents give no pieces.
    """
    return packing.pack(docs, max_tokens=2048, with_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("near copies", drop_near_copies),
    ("benchmark passages", drop_contaminated),
    ("personal data", redact),
    ("packing", pack),
]

#: Hashes, trained models and token ids have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written once and read by the next stage."""
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = stored(docs)
    return docs
