"""Keyed streaming state with a time to live: which visits must be scored, and what each tab shows.

Both are value state in the RocksDB store, one small row per key, so neither a log nor the batches written
so far are read again. State outlives what it must answer for and then goes by itself. A query goes on
from its checkpoint after a restart.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lurescan.operators import predlog as M

# the processors travel with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Stored scorings live this many times their time to live by the clock, so that a stream that lags
#: behind its events still finds them.
LAG = 2

#: A tab without a visit for so long by the clock is closed.
TAB_SECONDS = 7 * 86_400

SCHEDULE = "doc_id string, ts_us bigint, request_id bigint"


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Settings a query with expiring state takes along when it starts.

    State that expires by the clock would keep a bounded run busy with empty batches.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def greedy_times(times: np.ndarray, ids: np.ndarray, last: int | None, ttl_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The visits of one key that must be scored: the first that no scoring covers, again and again.

    A scoring at ``last`` covers the visits until ``last + ttl_us``, that moment included, and earlier ones.
    """
    order = np.lexsort((ids, times))
    times, ids = times[order], ids[order]
    picked = []
    at = 0 if last is None else int(np.searchsorted(times, last + ttl_us, "right"))
    while at < len(times):
        picked.append(at)
        at = int(np.searchsorted(times, times[at] + ttl_us, "right"))
    return times[picked], ids[picked]


class ScoringState(StatefulProcessor):
    """Per key the moment of its last scoring."""

    def __init__(self, ttl_seconds: int):
        self.ttl_us = ttl_seconds * 1_000_000
        self.kept_ms = ttl_seconds * 1_000 * LAG

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "ts_us bigint", ttlDurationMs=self.kept_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.last.get()
        last = None if state is None else state[0]
        times, ids = [], []
        for part in rows:
            if last is not None:  # most visits of a known site end here
                part = part[part["ts_us"] > last + self.ttl_us]
            times.append(part["ts_us"].to_numpy(np.int64))
            ids.append(part["request_id"].to_numpy(np.int64))
        times, ids = greedy_times(np.concatenate(times), np.concatenate(ids), last, self.ttl_us)
        if len(times):
            self.last.update((int(times[-1]),))
            yield pd.DataFrame({"doc_id": [key[0]] * len(times), "ts_us": times, "request_id": ids})

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.last.update((int(initialState["ts_us"].max()),))

    def close(self) -> None:
        pass


def _first_per_moment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of visits of one key at one moment only the first can be scored."""
    for batch in batches:
        table = pa.Table.from_batches([batch]).group_by(["doc_id", "ts_us"]).aggregate([("request_id", "min")])
        yield from table.select(["doc_id", "ts_us", "request_id_min"]).rename_columns(["doc_id", "ts_us", "request_id"]).to_batches()


def scoring_stream(visits: DataFrame, ttl_seconds: int = M.TTL_SECONDS, log: DataFrame | None = None) -> DataFrame:
    """The visits of a stream that must be scored: per key the first, then each first one after expiry.

    ``visits`` has doc_id, request_id and ts_us; rows without one of them are never scored. ``log`` seeds
    the state with the newest ``created_us`` per key when the query starts for the first time. Within a
    batch visits may come in any order; a visit older than the last scoring of an earlier batch needs
    none. A key's visits of one batch that lie after its expiry meet in one task as 16 bytes each, so
    their number is bounded by what the source puts into a batch; all others are dropped as they
    stream by.
    """
    usable = visits.select("doc_id", "ts_us", "request_id").dropna()
    thinned = usable.mapInArrow(_first_per_moment, SCHEDULE)
    seed = None
    if log is not None:
        newest = log.filter("doc_id IS NOT NULL AND created_us IS NOT NULL")
        seed = newest.groupBy("doc_id").agg(F.max("created_us").alias("ts_us")).groupBy("doc_id")
    return thinned.groupBy("doc_id").transformWithStateInPandas(
        ScoringState(ttl_seconds), outputStructType=SCHEDULE, outputMode="Append", timeMode="ProcessingTime", initialState=seed)


def run_schedule(
    visits: DataFrame, folder: str, ttl_seconds: int = M.TTL_SECONDS, log: DataFrame | None = None
) -> StreamingQuery:
    """Write the visits that must be scored below ``folder`` by batch; a repeated batch replaces its own rows."""
    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/schedule/batch_id={batch_id}")

    with _keyed_state(visits.sparkSession):
        return (
            scoring_stream(visits, ttl_seconds, log)
            .writeStream.outputMode("append")
            .foreachBatch(process)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )


def scheduled(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`run_schedule` has written."""
    return spark.read.schema(f"{SCHEDULE}, batch_id bigint").parquet(f"{folder}/schedule").drop("batch_id")


# --- tabs ------------------------------------------------------------------------------------------


class TabState(StatefulProcessor):
    """Per tab its newest row, by time and request."""

    def __init__(self, seconds: int):
        self.kept_ms = seconds * 1_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "ts_us bigint, request_id bigint, row string", ttlDurationMs=self.kept_ms)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.newest.get()
        best = None if state is None else tuple(state)
        for part in rows:
            for row in part[["ts_us", "request_id", "row"]].itertuples(index=False):
                if best is None or tuple(row[:2]) > best[:2]:
                    best = (int(row[0]), int(row[1]), row[2])
        self.newest.update(best)
        yield pd.DataFrame({"tab_id": [key[0]]})

    def close(self) -> None:
        pass


def _newest_per_tab(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table.sort_by([("tab_id", "ascending"), ("ts_us", "descending"), ("request_id", "descending")])
        tabs = table.column("tab_id").to_numpy()
        first = np.ones(len(tabs), bool)
        first[1:] = tabs[1:] != tabs[:-1]
        yield from table.filter(pa.array(first)).to_batches()


def run_tabs(visits: DataFrame, folder: str, seconds: int = TAB_SECONDS) -> StreamingQuery:
    """Keep the newest row of every tab as state; a tab without one for ``seconds`` is dropped.

    Rows without tab_id, ts_us or request_id are left out. Each Arrow batch of a task is reduced to one row per
    tab before the shuffle, so a tab with a third of all visits sends few.
    """
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in visits.columns]), {"ignoreNullFields": "false"}).alias("row")
    keys = [F.col(c).cast("bigint").alias(c) for c in ("tab_id", "ts_us", "request_id")]
    usable = visits.select(*keys, row).dropna(subset=["tab_id", "ts_us", "request_id"])
    with _keyed_state(visits.sparkSession):
        return (
            usable.mapInArrow(_newest_per_tab, usable.schema)
            .groupBy("tab_id")
            .transformWithStateInPandas(
                TabState(seconds), outputStructType="tab_id bigint", outputMode="Update", timeMode="ProcessingTime")
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )


def tabs_now(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The newest row of each open tab, from the state of the last finished batch; ``schema`` is that of the
    visits. Nothing that was written per batch is read."""
    state = spark.read.format("statestore").option("path", f"{folder}/checkpoint").option("stateVarName", "newest").load()
    live = state.filter(F.col("value.ttlExpirationMs") > F.unix_millis(F.current_timestamp()))
    return live.select(F.from_json("value.value.row", schema).alias("row")).select("row.*")
