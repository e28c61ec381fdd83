"""The keyed log: same rows as the whole-table operators, and untouched files keep their names."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lurescan.operators import predlog as M
from lurescan.sources.keyed import LOG_SCHEMA, KeyedLog

DAY = 86_400_000_000


def log_rows(n, seed=3, start=0):
    rng = random.Random(seed)
    return [
        (f"k{start + i}", f"http://{i}", None, rng.choice(["xgb", "rf", None]), rng.choice([0, 1, None]), rng.random(),
         rng.randint(0, 60) * DAY, None, None) for i in range(n)
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, LOG_SCHEMA)


def same(a, b):
    columns = sorted(a.columns)
    return sorted(map(repr, a.select(*columns).collect())) == sorted(map(repr, b.select(*columns).collect()))


def files(log):
    return {os.path.relpath(f, log.folder): os.stat(f).st_mtime_ns for f in glob.glob(f"{log.folder}/_bucket=*/*.parquet")}


def untouched(before, after, touched):
    """Files outside the touched buckets are the same, those inside are new."""
    inside = lambda f: int(f.split("/")[0].split("=")[1]) in touched
    assert {f: t for f, t in before.items() if not inside(f)} == {f: t for f, t in after.items() if not inside(f)}
    assert not {f for f in before if inside(f)} & {f for f in after if inside(f)}


@pytest.fixture
def stored(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), buckets=16)
    first = frame(spark, log_rows(400))
    log.put(first)
    return log, first


def test_an_empty_log(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "none"))
    assert log.rows().count() == 0 and log.rows().columns == log.columns
    assert log.put(frame(spark, [])) == [] and log.delete(frame(spark, log_rows(2))) == [] and log.expire(99 * DAY) == []
    assert log.put(frame(spark, [(None, *log_rows(1)[0][1:])])) == [] and log.rows().count() == 0


def test_put(spark, stored):
    log, first = stored
    assert same(log.rows(), first)
    assert all(len(glob.glob(f"{log.folder}/_bucket={b}/*.parquet")) == 1 for b in range(16))
    before = files(log)
    new = frame(spark, log_rows(3, seed=8, start=5) + log_rows(2, seed=9, start=5) + log_rows(1, start=1000))
    touched = log.put(new)
    assert 0 < len(touched) <= 4
    assert same(log.rows(), M.upsert(first, new))
    untouched(before, files(log), touched)
    again = log.rows().collect()
    log.put(new)
    assert sorted(map(repr, again)) == sorted(map(repr, log.rows().collect()))


def test_put_without_some_columns(spark, stored):
    log, _ = stored
    log.put(spark.createDataFrame([("new", 5)], "doc_id string, created_us int"))
    row = log.rows_of(spark.createDataFrame([("new",)], "doc_id string")).filter("doc_id = 'new'").first()
    assert (row.created_us, row.url, row.is_verified) == (5, None, None)


def test_update(spark, stored):
    log, first = stored
    updates = spark.createDataFrame(
        [("k7", 0, None), ("k7", None, True), ("k9", None, None), ("zzz", 1, True), (None, 1, True)],
        "doc_id string, pred int, is_verified boolean")
    before = files(log)
    touched = log.update(updates, F.lit(77))
    assert len(touched) == 1
    assert same(log.rows(), M.update_logs(first, updates, F.lit(77)))
    untouched(before, files(log), touched)


def test_delete_and_emptied_buckets(spark, stored):
    log, first = stored
    before = files(log)
    gone = first.filter("doc_id IN ('k1', 'k2')").select("doc_id").union(spark.createDataFrame([("zzz",), (None,)], "doc_id string"))
    touched = log.delete(gone)
    assert 1 <= len(touched) <= 2 and same(log.rows(), first.filter("doc_id NOT IN ('k1', 'k2')"))
    untouched(before, files(log), touched)
    whole = log.rows([3]).select("doc_id")
    expected = log.rows().join(whole.withColumnRenamed("doc_id", "d"), F.col("doc_id") == F.col("d"), "left_anti").collect()
    assert log.delete(whole) == [3] and not os.path.exists(f"{log.folder}/_bucket=3")
    assert sorted(map(repr, log.rows().collect())) == sorted(map(repr, expected))
    log.delete(log.rows())
    assert log.rows().count() == 0
    log.put(first)
    assert same(log.rows(), first)


def test_expiry(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path / "log"), buckets=16)
    rows = [(f"k{i}", None, None, None, 1, 0.5, (0 if i == 3 else 30) * DAY, None, None) for i in range(200)]
    log.put(frame(spark, rows))
    before = files(log)
    assert log.expire(30 * DAY) == []  # of exactly that age: kept
    touched = log.expire(30 * DAY + 1)
    assert len(touched) == 1 and same(log.rows(), frame(spark, rows).filter("doc_id <> 'k3'"))
    untouched(before, files(log), touched)


def test_only_touched_folders_are_read(spark, stored):
    log, _ = stored
    key = spark.createDataFrame([("k1",)], "doc_id string")
    found = log.rows_of(key)
    read = found.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("_bucket=")[1].split("/")[0] for r in read} == {str(b) for b in log._touched(key)}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan
