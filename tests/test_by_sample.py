"""Attribution summaries of whole samples: the texts are shuffled once, the rows of their words never."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F

from lurescan import schemas
from lurescan.operators import attributions as L
from lurescan.plans import evaluation_queries as E
from lurescan.plans.registry import Tables

BY_SAMPLE = ["both_classes", "top_tokens", "cumulative_values", "token_rows"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("by-sample"))
    rows = [(i, " ".join(f"w{i * j % 7}" for j in range(i % 40)), "en", "web", 5) for i in range(60)]
    documents = [*rows, (None, "a b a", None, "web", 5), (7, "again the same id", "en", "web", 5), (61, None, "en", "web", 0)]
    df = spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{folder}/documents.parquet")
    return Tables(spark, folder)


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


@pytest.mark.parametrize("name", BY_SAMPLE)
def test_rows_of_words_are_not_shuffled(tables, name):
    text = plan(getattr(E, name)(tables))
    assert text.count("Exchange") == 1
    assert text.index("Generate posexplode") < text.index("Exchange")  # below it, on the texts


def test_layout_keeps_the_rows(tables):
    apart, together = E.attributions(tables), E.attributions(tables, by_sample=True)
    assert apart.exceptAll(together).count() == together.exceptAll(apart).count() == 0


def test_both_classes_by_sample(tables):
    found = E.both_classes(tables)
    plain = L.both_classes(E.attributions(tables), 20)
    keep = ["sample_id", "rank", "pos", "mean_abs"]
    assert found.select(keep).exceptAll(plain.select(keep)).count() == 0 and found.count() == plain.count()


def test_whole_samples_equal_chunks(spark):
    rows = [(s, p, f"t{p % 5}", 1, (p * 37 % 11 - 5) / 64) for s in (1, 2, None) for p in range(2500 if s == 1 else 12)]
    df = spark.createDataFrame([*rows, (2, 3, "twice", 1, rows[3][4])], schemas.ATTRIBUTIONS)
    keep = ["sample_id", "pos", "token", "value", "is_top"]
    whole, chunks = L.cumulative_values(df, whole_samples=True), L.cumulative_values(df.filter("sample_id IS NOT NULL"))
    named = whole.filter("sample_id IS NOT NULL")
    assert named.select(keep).exceptAll(chunks.select(keep)).count() == 0 and named.count() == chunks.count()
    last = F.max_by("cumulative", "pos").alias("sum")
    sums = [{r["sample_id"]: round(r["sum"], 9) for r in found.groupBy("sample_id").agg(last).collect()} for found in (named, chunks)]
    assert sums[0] == sums[1]
