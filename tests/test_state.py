"""Keyed streaming state: restarts, order, expiry."""

import random
import time

import numpy as np
import pytest

from lurescan.streaming import state as K

TTL = 100
SCHEMA = "doc_id string, request_id bigint, ts_us bigint, note string"
SECOND = 1_000_000


def rows_of(n=900, seed=2):
    """Visits of a hot key and others, with ties; the times of a third of the span per batch."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randint(0, 12)}"
        at = (i // 300) * 1000 + rng.randint(0, 999)
        out.append((key, i, at * SECOND + rng.choice([0, 0, 1]), "n"))
    return out


def expected(rows, last=None):
    last, out = dict(last or {}), set()
    for key, rid, ts, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or ts > last[key] + TTL * SECOND:
            last[key] = ts
            out.add((key, ts, rid))
    return out


def write(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder, schema=SCHEMA):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def schedule(spark, out):
    return sorted(tuple(r) for r in K.scheduled(spark, out).collect())


def test_times_against_the_rule():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 200):
        times = rng.integers(0, 40, n) * 10
        ids = rng.permutation(n)
        for last in (None, -500, 0, 95, 10_000):
            rows = [("k", int(i), int(t) * SECOND, "") for t, i in zip(times, ids)]
            want = expected(rows, {} if last is None else {"k": last * SECOND})
            got = K.greedy_times(times * SECOND, ids, None if last is None else last * SECOND, TTL * SECOND)
            assert {("k", int(t), int(i)) for t, i in zip(*got)} == want


def test_a_restart_goes_on(spark, tmp_path):
    rows, source, out = rows_of(), str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        write(spark, source, rows[300 * k : 300 * k + 300])
        K.run_schedule(stream(spark, source), out, TTL).awaitTermination()
    assert schedule(spark, out) == sorted(expected(rows))


def test_one_run_over_all_batches_and_a_seed(spark, tmp_path):
    rows, source, out = rows_of(seed=4), str(tmp_path / "in"), str(tmp_path / "out")
    for k in range(3):
        write(spark, source, rows[300 * k : 300 * k + 300])
    write(spark, source, [(None, 1, 1, ""), ("k1", None, 1, ""), ("k1", 1, None, "")])
    log = spark.createDataFrame(
        [("hot", 500 * SECOND), ("hot", 100 * SECOND), ("k3", 0), (None, 3), ("k4", None)], "doc_id string, created_us bigint")
    K.run_schedule(stream(spark, source), out, TTL, log).awaitTermination()
    assert schedule(spark, out) == sorted(expected(rows, {"hot": 500 * SECOND, "k3": 0}))
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"


def test_late_visits_of_a_scored_key_are_not_scored(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, [("a", 1, 1000 * SECOND, "")])
    K.run_schedule(stream(spark, source), out, TTL).awaitTermination()
    write(spark, source, [("a", 2, 10 * SECOND, ""), ("a", 3, 1100 * SECOND, ""), ("a", 4, 1101 * SECOND, "")])
    K.run_schedule(stream(spark, source), out, TTL).awaitTermination()
    assert schedule(spark, out) == [("a", 1000 * SECOND, 1), ("a", 1101 * SECOND, 4)]


TABS = "request_id bigint, tab_id bigint, ts_us bigint, url string, threshold double, big bigint, tags array<string>"


def tab_rows(n, seed):
    rng = random.Random(seed)
    return [
        (i, rng.choice([1, 1, 1, 2, 3, 4]), rng.randint(0, 60), rng.choice([None, "é \"q\"", ""]), rng.choice([None, float("nan"), 0.1]),
         rng.choice([None, 2**60 + 1]), rng.choice([None, [], ["a", None]])) for i in range(n)
    ]


def test_newest_row_per_tab(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = tab_rows(300, 7) + [(1000, None, 99, "x", None, None, None), (None, 9, 99, "x", None, None, None)]
    for k in range(3):
        spark.createDataFrame(rows[k::3], TABS).coalesce(1).write.mode("append").parquet(source)
    visits = stream(spark, source, TABS)
    K.run_tabs(visits, out).awaitTermination()
    newest = {}
    for r in rows:
        if r[0] is not None and r[1] is not None and (r[1] not in newest or (r[2], r[0]) > (newest[r[1]][2], newest[r[1]][0])):
            newest[r[1]] = r
    got = K.tabs_now(spark, out, visits.schema)
    assert got.schema.names == visits.schema.names
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, newest.values()))


def test_closed_tabs_go(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 1, 1, "a", None, None, None)], TABS).coalesce(1).write.mode("append").parquet(source)
    visits = stream(spark, source, TABS)
    K.run_tabs(visits, out, seconds=20).awaitTermination()
    assert [r.tab_id for r in K.tabs_now(spark, out, visits.schema).collect()] == [1]
    time.sleep(20)
    spark.createDataFrame([(2, 2, 2, "b", None, None, None)], TABS).coalesce(1).write.mode("append").parquet(source)
    K.run_tabs(visits, out, seconds=20).awaitTermination()
    assert [r.tab_id for r in K.tabs_now(spark, out, visits.schema).collect()] == [2]
    state = spark.read.format("statestore").option("path", f"{out}/checkpoint").option("stateVarName", "newest").load()
    assert state.count() == 1


@pytest.mark.parametrize("rows", [[], [("a", 1, 5, "")]])
def test_empty_batches(spark, tmp_path, rows):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    write(spark, source, [])
    write(spark, source, rows)
    K.run_schedule(stream(spark, source), out, TTL).awaitTermination()
    assert schedule(spark, out) == [("a", 5, 1)][: len(rows)]
