"""Browser visits as a stream: gate, configuration, cached scoring, verdicts, latest per tab.

Each micro-batch is served with set operations against an append-only log that is partitioned by
batch, so a retried batch overwrites its own partition and a hot site does not end in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lurescan.operators import predlog as M
from lurescan.operators.tables import cut_lineage, join_split_hot, remove_folder

# --- fixed values: visit configuration -------------------------------------------------------------
VISIT_DEFAULTS = {"model": "rf", "threshold": 0.6, "scan_mode": "full"}

LOG_SCHEMA = (
    "doc_id string, url string, original_url string, model string, pred int, proba double, "
    "created_us bigint, request_id bigint, batch_id bigint, day int"
)


def is_web_url(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("^https?://"), F.lit(False))


def configured(visits: DataFrame, known_models: Sequence[str]) -> DataFrame:
    """Fill model, threshold (NaN as missing, clamped to 0..1) and mode; add the request columns."""
    given = F.col("threshold").cast("double")
    threshold = F.coalesce(F.nanvl(given, F.lit(None).cast("double")), F.lit(VISIT_DEFAULTS["threshold"]))
    clamped = F.least(F.greatest(threshold, F.lit(0.0)), F.lit(1.0))
    return M.normalise_requests(
        visits.withColumn("threshold", clamped), known_models, VISIT_DEFAULTS
    )


def verdict_rows(served: DataFrame) -> DataFrame:
    """One row per visit: badge P, OK, ERR or '' (a cleared tab), is_phishing and error.

    A visit without a verdict is never shown as safe: it is an error and has no is_phishing.
    """
    web = F.col("is_web") == 1
    phishing = F.col("pred") == 0
    failed = web & F.col("error").isNull() & F.col("pred").isNull()
    return served.withColumn("error", F.when(failed, M.FAILED).otherwise(F.col("error"))).withColumns(
        {
            "badge": F.when(~web, "")
            .when(F.col("error").isNotNull(), "ERR")
            .when(phishing, "P")
            .otherwise("OK"),
            "is_phishing": F.when(web & F.col("error").isNull(), phishing.cast("int")),
        }
    )


DAY_US = 86_400_000_000


def read_log(spark: SparkSession, folder: str, before_batch: int, since_us: int = 0) -> DataFrame | None:
    """Log rows of earlier batches from the day of ``since_us`` on, None before the first.

    The log is partitioned by batch and day, so what has expired is not read.
    """
    try:
        rows = spark.read.schema(LOG_SCHEMA).parquet(folder)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter((F.col("batch_id") < before_batch) & (F.col("day") >= since_us // DAY_US))


def serve_batch(
    visits: DataFrame,
    log: DataFrame | None,
    scorer: M.Scorer,
    known_models: Sequence[str],
    ttl_seconds: int,
    store: Callable[[DataFrame], DataFrame],
    folder: str | None = None,
) -> DataFrame:
    """Verdict rows of one batch of visits; ``store`` keeps the new log rows and returns them.

    ``visits`` has request_id, tab_id, ts_us, url, model, threshold and scan_mode. A scored row
    covers the visits of its key from its creation until it expires, so at most one row covers a
    visit. A visit that is older than the log row of an earlier batch is answered by that row.
    Intermediate tables are checkpoints, or written below ``folder``.
    """
    ttl = ttl_seconds * 1_000_000
    gated = configured(visits, known_models).withColumn("is_web", is_web_url(F.col("url")).cast("int"))
    usable = gated.filter("is_web = 1 AND error IS NULL")
    keys, hot = M.materialised_visits(usable, folder)
    newest = None
    if log is not None:
        row = F.max_by(F.struct("pred", "proba", "created_us"), "created_us").alias("_row")
        newest = cut_lineage(log.groupBy("doc_id").agg(row).select("doc_id", "_row.*"), folder)
    schedule = M.scoring_schedule(keys, newest, ttl_seconds, hot, folder)
    to_score = usable.join(schedule.select("request_id"), "request_id", "left_semi")
    scored = M.score_requests(to_score, scorer, F.col("ts_us"))
    new_rows = store(scored.filter("pred IS NOT NULL"))

    columns = ["doc_id", "pred", "proba", "created_us"]
    verdicts = new_rows.select(
        *columns, F.col("request_id").alias("_scored_by"), F.col("created_us").alias("_from")
    )
    if newest is not None:
        verdicts = verdicts.unionByName(
            newest.select(
                *columns,
                F.lit(None).cast("bigint").alias("_scored_by"),
                F.lit(0).cast("bigint").alias("_from"),
            )
        )
    asked = gated.withColumn(
        "_key", F.when((F.col("is_web") == 1) & F.col("error").isNull(), F.col("doc_id"))
    )
    answers = verdicts.withColumnRenamed("doc_id", "_key")
    covered = F.col("ts_us").between(F.col("_from"), F.col("created_us") + ttl)
    served = join_split_hot(asked, answers, "_key", "left", covered, hot).drop(
        "_key", "_from", "created_us"
    )
    cached = F.col("_scored_by").isNull() | (F.col("_scored_by") != F.col("request_id"))
    return verdict_rows(
        served.withColumn("cached", F.when(F.col("pred").isNotNull(), cached.cast("int")))
    ).drop("_scored_by")


def run_visits(
    visits: DataFrame,
    folder: str,
    scorer: M.Scorer,
    known_models: Sequence[str],
    ttl_seconds: int = M.TTL_SECONDS,
) -> StreamingQuery:
    """Serve a stream of visits; log and verdicts are written below ``folder`` by batch."""
    log_folder, out_folder = f"{folder}/log", f"{folder}/verdicts"

    def process(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession

        def store(rows: DataFrame) -> DataFrame:
            path = f"{log_folder}/batch_id={batch_id}"
            dated = rows.withColumn("day", F.floor(F.col("created_us") / DAY_US).cast("int"))
            dated.write.mode("overwrite").partitionBy("day").parquet(path)
            return spark.read.schema(f"{rows.schema.toDDL()}, day int").parquet(path).drop("day")

        # an older row covers no visit of this batch
        first = batch.agg(F.min("ts_us")).first()[0]
        since = (first or 0) - ttl_seconds * 1_000_000
        log = read_log(spark, log_folder, batch_id, since)
        scratch = f"{folder}/scratch/batch_id={batch_id}"
        remove_folder(spark, scratch)  # of an attempt that was cut off
        served = serve_batch(batch, log, scorer, known_models, ttl_seconds, store, scratch)
        served.write.mode("overwrite").parquet(f"{out_folder}/batch_id={batch_id}")
        remove_folder(spark, scratch)

    return (
        visits.writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def latest_per_tab(verdicts: DataFrame) -> DataFrame:
    """The newest result of every tab (batch or stream; a stream runs in update mode)."""
    columns = [c for c in verdicts.columns if c != "tab_id"]
    newest = F.max_by(F.struct(*columns), F.struct("ts_us", "request_id")).alias("_row")
    return verdicts.groupBy("tab_id").agg(newest).select("tab_id", "_row.*")


def run_latest_per_tab(visits: DataFrame, folder: str) -> StreamingQuery:
    """Keep the latest visit of every tab as streaming state and write each batch's changes."""

    def process(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/tabs/batch_id={batch_id}")

    return (
        latest_per_tab(visits)
        .writeStream.outputMode("update")
        .foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def current_tabs(spark: SparkSession, folder: str) -> DataFrame:
    """State of the tabs after the batches written so far."""
    return latest_per_tab(spark.read.parquet(f"{folder}/tabs")).drop("batch_id")
