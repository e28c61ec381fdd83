"""Streams in several batches, resumable builds and file formats."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lurescan import schemas
from lurescan.operators import predlog as M
from lurescan.operators import sampling as S
from lurescan.sources import files, resumable
from lurescan.streaming import visits as N

HOUR = 3_600_000_000
TTL = 30 * 3600
MODELS = ["rf", "xgb"]


def visits_of(n=400, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        site = "hot.com" if rng.random() < 0.4 else f"s{rng.randint(0, 20)}.com"
        scheme = rng.choice(["http", "HTTPS", "chrome"]) if rng.random() < 0.3 else "https"
        rows.append(
            (
                i, rng.randint(0, 9), i * HOUR // 2, f"{scheme}://{site}/{rng.randint(0, 3)}",
                rng.choice([None, "rf", "bad"]), rng.choice([None, float("nan"), 1.7, 0.5]),
                rng.choice([None, "domain"]),
            )
        )
    return rows


def scorer(requests):
    code = F.conv(F.substring(F.md5(F.col("request_id").cast("string")), 1, 4), 16, 10).cast("double")
    return requests.withColumn("proba", code / 65536)


def expected_verdicts(rows):
    """The serving rule visit by visit."""
    log, out = {}, {}
    for rid, _tab, ts, url, model, _threshold, mode in rows:
        model, mode = model or "rf", mode or "full"
        if not url.lower().startswith("http"):
            out[rid] = ("", None)
        elif model == "bad":
            out[rid] = ("ERR", None)
        else:
            key = (url.split("/")[2].lower(), model, mode)
            if key not in log or ts - log[key][0] > TTL * 1_000_000:
                log[key] = (ts, rid)
                out[rid] = (rid, 0)
            else:
                out[rid] = (log[key][1], 1)
    return out


@pytest.mark.parametrize("n_files", [1, 5])
def test_stream_equals_visit_by_visit(spark, tmp_path, n_files):
    rows = visits_of()
    source = tmp_path / "in"
    size = len(rows) // n_files
    for i in range(n_files):
        part = rows[i * size : (i + 1) * size]
        spark.createDataFrame(part, schemas.VISITS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(schemas.VISITS).option("maxFilesPerTrigger", 1).parquet(str(source))
    folder = str(tmp_path / "out")
    N.run_visits(stream, folder, scorer, MODELS, TTL).awaitTermination()
    found = spark.read.parquet(f"{folder}/verdicts")
    assert found.select("batch_id").distinct().count() == n_files
    assert os.listdir(f"{folder}/scratch") == []
    expected = expected_verdicts(rows)
    probas = {
        r["request_id"]: r["proba"]
        for r in scorer(spark.createDataFrame([(r[0],) for r in rows], "request_id long")).collect()
    }
    got = {r["request_id"]: r for r in found.collect()}
    assert len(got) == found.count() == len(rows)
    for rid, (who, cached) in expected.items():
        row = got[rid]
        if who in ("", "ERR"):
            assert row["badge"] == who and row["pred"] is None
        else:
            assert row["proba"] == probas[who] and row["cached"] == cached
            assert row["badge"] == ("P" if row["pred"] == 0 else "OK")


def test_thresholds(spark):
    rows = [(i, 0, 0, "http://a/", None, t, None) for i, t in enumerate([1.7, float("nan"), None, -3.0, 0.25])]
    df = N.configured(spark.createDataFrame(rows, schemas.VISITS), MODELS)
    assert [r["threshold"] for r in df.orderBy("request_id").collect()] == [1.0, 0.6, 0.6, 0.0, 0.25]


def test_latest_per_tab_over_batches(spark, tmp_path):
    rows = visits_of(60)
    for part in (rows[:30], rows[30:]):
        spark.createDataFrame(part, schemas.VISITS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schemas.VISITS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    N.run_latest_per_tab(stream, str(tmp_path / "out")).awaitTermination()
    found = {r["tab_id"]: r["request_id"] for r in N.current_tabs(spark, str(tmp_path / "out")).collect()}
    expected = {}
    for r in rows:
        expected[r[1]] = r[0]
    assert found == expected


def test_two_urls_of_one_host_share_a_verdict(spark):
    requests = spark.createDataFrame(
        [(1, "http://a.com/1", "rf", 0.5, None), (2, " http://a.com/2", "rf", 0.9, None), (3, "", None, None, None)],
        schemas.PREDICT_REQUEST,
    )
    asked = M.normalise_requests(requests, MODELS)
    log = spark.createDataFrame([], "doc_id string, url string, original_url string, model string, pred int, proba double, created_us long")
    new = M.rows_to_score(asked, log, scorer, F.lit(0))
    rows = {r["request_id"]: r for r in M.responses(asked, log, new, F.lit(0)).collect()}
    assert new.count() == 1
    assert (rows[1]["cached"], rows[2]["cached"], rows[3]["cached"]) == (0, 1, None)
    assert rows[2]["url"] == "http://a.com/2" and rows[1]["proba"] == rows[2]["proba"]
    assert rows[3]["error"] == "Missing 'url'"
    later = M.responses(asked, M.upsert(log, new.drop("request_id")), new.limit(0), F.lit(TTL * 1_000_000), TTL)
    assert {r["cached"] for r in later.collect()} == {1, None}


def test_resumed_build_equals_one_go(spark, tmp_path):
    rows = spark.range(1000).select(F.col("id").alias("row_idx"), F.concat(F.lit("u"), "id").alias("url"))
    calls = []

    def build(part):
        calls.append(1)
        return part.withColumn("n", F.length("url"))

    folder = str(tmp_path / "chunks")
    resumable.build_resumable(rows.filter("row_idx < 400"), build, folder, step=100, writes=2)
    assert len(calls) == 2
    assert resumable.build_resumable(rows, build, folder, step=100, writes=3) == 3
    assert resumable.build_resumable(rows, build, folder, step=100) == 0
    done = spark.read.parquet(folder)
    assert done.count() == 1000 and done.select("row_idx").distinct().count() == 1000


def test_url_list_with_quotes(spark, tmp_path):
    path = tmp_path / "list.csv"
    path.write_text('url;label\n"http://a/;x";1\n"http://b/""q""";0\n"two\nlines";1\n', encoding="utf-8")
    rows = files.read_url_list(spark, str(path), multi_line=True).collect()
    assert [(r["url"], r["label"]) for r in rows] == [("http://a/;x", 1), ('http://b/"q"', 0), ("two\nlines", 1)]


def test_byte_order_mark_and_audit(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿url,label\na,1\n", encoding="utf-8")
    assert files.read_table(spark, str(path)).columns == ["url", "label"]
    broken = tmp_path / "b.csv"
    broken.write_text("url;label\na;1\nb;x;y\nc;0\n", encoding="utf-8")
    good = files.read_tolerant(spark, str(broken), schemas.URL_LIST)
    assert [r["url"] for r in good.collect()] == ["a", "c"]
    audit = files.read_with_audit(spark, str(broken), schemas.URL_LIST)
    assert [r["_corrupt_record"] for r in audit.collect()] == [None, "b;x;y", None]


def test_brands_rules_and_results(spark, tmp_path):
    (tmp_path / "brands.txt").write_text(" a \n\nb\na\n", encoding="utf-8")
    assert sorted(r["brand"] for r in files.read_brands(spark, str(tmp_path / "brands.txt")).collect()) == ["a", "b"]
    (tmp_path / "rules.txt").write_text("// list\ncom\n\n*.ck\n", encoding="utf-8")
    assert sorted(files.read_suffix_rules(spark, str(tmp_path / "rules.txt"))) == ["*.ck", "com"]
    df = spark.createDataFrame([(1, 2.5)], "a int, b double")
    files.write_results({"x": df}, str(tmp_path / "csv"))
    files.write_results({"x": df}, str(tmp_path / "json"), "json")
    assert spark.read.json(str(tmp_path / "json" / "x")).first()["b"] == 2.5
    assert spark.read.csv(str(tmp_path / "csv" / "x"), header=True).first()["a"] == "1"


def test_last_rows_split(spark):
    df = spark.range(100).select((F.col("id") * 2).alias("k"))
    rows = S.last_rows_split(df, "k").filter("split = 'validation'").collect()
    assert sorted(r["k"] for r in rows) == [2 * i for i in range(85, 100)]
