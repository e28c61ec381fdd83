"""Registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescan.llm import (
    decontaminate, fingerprints, html_text, license_scan, packing, pii, prefix_trie, quality, secrets, simhash,
    substrings, toxicity, whitening,
)
from lurescan.llm.text import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@register
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"), shingle=5, scale=8)


@register
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_text.train(html_text.labelled_pages())
    return html_text.extract(table(spark, sf_dir, "pages"), model, keep=["page_id", "url"])


@register
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


@register
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), threshold=license_scan.CONTAINMENT)


ORACLES["op5_license_scan"] = license_scan.oracle_sql()


@register
def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, distance=2)


@register
def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(documents, benchmark, window=10)


ORACLES["op7_decontaminate"] = decontaminate.oracle_sql(window=10)


@register
def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), threshold=0.5)


@register
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


@register
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), max_tokens=2048)


@register
def op11_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substrings.deduplicated(table(spark, sf_dir, "documents"), window=13)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op11_substrings"] = substrings.oracle_sql(window=13)


@register
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"), components=4)


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


ORACLES["op13_prefix_trie"] = prefix_trie.oracle_sql()
