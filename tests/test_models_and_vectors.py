"""Several models over one pass, and sparse token vectors."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lurescan.operators import attributions as L
from lurescan.operators import scoring as J

FOLDER = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation ")


def test_one_scan_for_all_models(spark):
    for name in ("scores_by_model", "external_scores_by_model"):
        assert scans(entry.queries()[name](spark, FOLDER)) == 1


def test_scorers_with_several_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, 0.5, "old", 9.0), (2, None, "old", 9.0)], "id int, x double, model string, proba double")
    scorers = {m: (lambda k: lambda d: d.withColumns({"proba": F.col("x") * k, "pred": F.lit(k)}))(k) for k, m in enumerate("abc")}
    got = J.score_models(df, scorers, ["c", "a"])
    assert got.columns == ["id", "x", "pred", "proba", "model"] or set(got.columns) == {"id", "x", "pred", "proba", "model"}
    assert {(r.id, r.model, r.proba, r.pred) for r in got.collect()} == {
        (1, "c", 1.0, 2), (1, "a", 0.0, 0), (2, "c", None, 2), (2, "a", None, 0)}
    with pytest.raises(ValueError, match="unknown models"):
        J.score_models(df, scorers, ["z"])
    with pytest.raises(ValueError, match="unknown models"):
        J.score_external_models(df, {}, ["z"], ["x"])


def test_vectors(spark):
    rows = [(1, 0, " a", 1, 0.5), (1, 1, "a", 1, 0.25), (1, 2, "b", 1, 1.0), (1, 3, "b", 1, -1.0), (2, 0, "c", 1, 3.0), (3, 0, "rare", 1, 1.0),
            (4, 0, "a", 1, 2.0), (4, 1, "c", 1, 1.0), (1, 0, "a", 0, 9.0)]
    df = spark.createDataFrame(rows, "sample_id long, pos int, token string, class_idx int, value double")
    ids = L.token_ids(df, 3)
    order = {r.token: r.id for r in ids.collect()}
    assert sorted(order.values()) == [0, 1, 2] and order["a"] == 0
    vectors = {r.sample_id: r.features for r in L.token_vectors(df, ids, 3).collect()}
    assert vectors[1].size == 3 and vectors[1][order["a"]] == 0.75
    assert order["b"] in vectors[1].indices and vectors[1][order["b"]] == 0.0
    assert len(vectors[3].indices) == 0
    a = sorted(map(tuple, L.vector_entries(L.token_vectors(df, ids, 3), ids).collect()))
    assert a == sorted(map(tuple, L.token_matrix(df, 3).select("sample_id", "token", "value", "present").collect()))


def test_many_tokens(spark):
    df = spark.range(3000).select(
        (F.col("id") % 10).alias("sample_id"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("t"), "id").alias("token"),
        F.lit(1).alias("class_idx"), F.lit(1.0).alias("value"))
    got = L.token_vectors(df, L.token_ids(df, 2500), 2500).collect()
    assert sum(len(r.features.indices) for r in got) == 2500
