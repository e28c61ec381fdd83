"""Prediction cache and log.

The log has one row per ``doc_id`` = ``sha256(site):model_mode``. Requests look their key up; a
missing or expired key is scored once. Every join is with a table that is unique on the key, and
the choice of the request to score is combined before the shuffle, so a site with a large share of
the requests neither multiplies rows nor collects in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from lurescan.functions import url as U
from lurescan.operators.scoring import threshold_pred
from lurescan.operators.tables import cut_lineage, hot_keys, join_split_hot

TTL_SECONDS = 30 * 86_400
PAGE_SIZE = 10

# --- fixed values: request defaults ----------------------------------------------------------------
REQUEST_DEFAULTS = {"model": "xgb", "threshold": 0.5, "scan_mode": "full"}

#: Error of a usable request whose scorer gave no result.
FAILED = "Scoring failed"

LOG_COLUMNS = ["doc_id", "url", "original_url", "model", "pred", "proba", "created_us"]

Scorer = Callable[[DataFrame], DataFrame]


def normalise_requests(
    requests: DataFrame, known_models: Sequence[str], defaults: dict = REQUEST_DEFAULTS
) -> DataFrame:
    """Fill defaults, add original_url, the scanned url, doc_id and error (NULL if usable)."""
    url = F.coalesce("url", F.lit(""))
    filled = requests.withColumns(
        {
            "model": F.lower(F.coalesce("model", F.lit(defaults["model"]))),
            "threshold": F.coalesce(F.col("threshold").cast("double"), F.lit(defaults["threshold"])),
            "scan_mode": F.coalesce("scan_mode", F.lit(defaults["scan_mode"])),
            "original_url": U.strip(url),
            "url": url,
        }
    )
    # fixed values: the two messages
    return filled.withColumns(
        {
            "error": F.when(F.col("url") == "", "Missing 'url'").when(
                ~F.col("model").isin(list(known_models)),
                F.concat(F.lit("Unknown model '"), "model", F.lit("'")),
            ),
            "url": U.scan_target(F.col("original_url"), F.col("scan_mode")),
        }
    ).withColumn("doc_id", U.cache_key(F.col("url"), F.col("model"), F.col("scan_mode")))


def upsert(log: DataFrame, rows: DataFrame, stamp: str = "created_us") -> DataFrame:
    """Keyed put: the newest row per doc_id wins, among equally new ones the put row, then by a hash."""
    both = log.withColumn("_put", F.lit(0)).unionByName(rows.withColumn("_put", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_put"]
    newest = F.max_by(F.struct(*columns), F.struct(stamp, "_put", F.xxhash64(*columns))).alias("_row")
    return both.groupBy("doc_id").agg(newest).select("_row.*")


def live_rows(log: DataFrame, as_of_us: Column, ttl_seconds: int = TTL_SECONDS) -> DataFrame:
    """Rows not older than the time to live; a row of exactly that age is kept."""
    return log.filter(as_of_us - F.col("created_us") <= ttl_seconds * 1_000_000)


def first_requests(requests: DataFrame, order: str, columns: Sequence[str]) -> DataFrame:
    """The earliest request per doc_id."""
    first = F.min_by(F.struct(*columns), F.struct(order, "request_id")).alias("_row")
    return requests.groupBy("doc_id").agg(first).select("doc_id", "_row.*")


def score_requests(requests: DataFrame, scorer: Scorer, created_us: Column) -> DataFrame:
    """Log rows for requests: the scorer adds proba, the request's threshold decides.

    A scorer that fails gives NULL; such rows have no verdict and must not be stored.
    """
    return scorer(requests).select(
        "doc_id",
        "url",
        "original_url",
        "model",
        threshold_pred(F.col("proba"), F.col("threshold")).alias("pred"),
        "proba",
        created_us.alias("created_us"),
        "request_id",
    )


_REQUEST = ["request_id", "url", "original_url", "model", "threshold", "scan_mode"]


def rows_to_score(
    requests: DataFrame, log: DataFrame, scorer: Scorer, as_of_us: Column,
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """New log rows for a batch of requests at one moment: one per missing or expired key.

    A key whose scoring failed has no row, so the next batch tries it again.
    """
    live = live_rows(log, as_of_us, ttl_seconds).select("doc_id")
    missed = join_split_hot(requests.filter("error IS NULL"), live, "doc_id", "left_anti")
    scored = score_requests(first_requests(missed, "request_id", _REQUEST), scorer, as_of_us)
    return scored.filter("pred IS NOT NULL")


def responses(
    requests: DataFrame, log: DataFrame, new_rows: DataFrame, as_of_us: Column,
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """One row per request: its own url, the stored or new verdict, cached, error.

    A usable request without a verdict is a failed scoring.
    """
    stored = live_rows(log, as_of_us, ttl_seconds).select(
        "doc_id", "pred", "proba", F.lit(None).cast("bigint").alias("_scored_by")
    )
    fresh = new_rows.select("doc_id", "pred", "proba", F.col("request_id").alias("_scored_by"))
    verdicts = stored.unionByName(fresh)
    usable = F.when(F.col("error").isNull(), F.col("doc_id"))
    answered = join_split_hot(requests.withColumn("doc_id", usable), verdicts, "doc_id")
    cached = F.col("_scored_by").isNull() | (F.col("_scored_by") != F.col("request_id"))
    failed = F.col("error").isNull() & F.col("pred").isNull()
    return answered.withColumns({
        "cached": F.when(F.col("error").isNull() & ~failed, cached.cast("int")),
        "error": F.when(failed, FAILED).otherwise(F.col("error")),
    }).drop("_scored_by")


def answered_requests(
    requests: DataFrame, log: DataFrame, scorer: Scorer, as_of_us: Column, ttl_seconds: int = TTL_SECONDS,
) -> tuple[DataFrame, DataFrame]:
    """:func:`responses` and :func:`rows_to_score` with one lookup in the log for both.

    The requests are joined with the log once and stored; only those without a live row are joined with
    the new rows.
    """
    live = live_rows(log, as_of_us, ttl_seconds).select("doc_id", "pred", "proba", F.lit(True).alias("_live"))
    usable = F.when(F.col("error").isNull(), F.col("doc_id"))
    looked_up = cut_lineage(join_split_hot(requests.withColumn("doc_id", usable), live, "doc_id"))
    open_request = F.col("error").isNull() & F.col("_live").isNull()
    missed = looked_up.filter(open_request).drop("pred", "proba", "_live")
    new_rows = score_requests(first_requests(missed, "request_id", _REQUEST), scorer, as_of_us)
    new_rows = cut_lineage(new_rows.filter("pred IS NOT NULL"))
    fresh = new_rows.select("doc_id", "pred", "proba", F.col("request_id").alias("_scored_by"))
    scored = join_split_hot(missed, fresh, "doc_id").withColumns({
        "cached": F.when(F.col("pred").isNotNull(), (F.col("_scored_by") != F.col("request_id")).cast("int")),
        "error": F.when(F.col("pred").isNull(), FAILED),
    }).drop("_scored_by")
    found = looked_up.filter(~open_request).withColumn(
        "cached", F.when(F.col("_live"), F.lit(1))).drop("_live")
    return found.unionByName(scored), new_rows


def materialised_visits(visits: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Keys and times of the visits, stored so that no round derives them again, and hot keys."""
    stored = cut_lineage(visits.select("doc_id", "request_id", "ts_us"), folder)
    return stored, hot_keys(stored, "doc_id", folder=folder)


def scoring_schedule(
    visits: DataFrame,
    log: DataFrame | None = None,
    ttl_seconds: int = TTL_SECONDS,
    hot: DataFrame | None = None,
    folder: str | None = None,
) -> DataFrame:
    """The visits that must be scored: per key the first, then each first one after expiry.

    ``visits`` has doc_id, request_id and ts_us. Expiry counts from the scoring, not from the last
    use. Round r finds the r-th scoring of every key with one minimum per key. Only the visits after
    its expiry go on to the next round, so a key without any is finished, and no key's visits are
    gathered. ``hot`` comes with visits that are stored already. The tables of the rounds are
    checkpoints, or written below ``folder``.
    """
    ttl = ttl_seconds * 1_000_000
    if hot is None:
        visits, hot = materialised_visits(visits, folder)
    earliest = F.min(F.struct("ts_us", "request_id")).alias("_first")

    def firsts(open_visits: DataFrame) -> DataFrame:
        found = open_visits.groupBy("doc_id").agg(earliest)
        return cut_lineage(found.select("doc_id", "_first.ts_us", "_first.request_id"), folder)

    def after(open_visits: DataFrame, previous: DataFrame) -> DataFrame:
        last = previous.select("doc_id", F.col("ts_us").alias("_last"))
        expired = F.col("ts_us") > F.col("_last") + ttl
        later = join_split_hot(open_visits, last, "doc_id", "inner", expired, hot)
        return cut_lineage(later.drop("_last"), folder)

    if log is not None:
        known = log.groupBy("doc_id").agg(F.max("created_us").alias("_last"))
        opened = join_split_hot(visits, known, "doc_id", hot=hot).filter(
            F.col("_last").isNull() | (F.col("ts_us") > F.col("_last") + ttl)
        )
        visits = cut_lineage(opened.drop("_last"), folder)
    rounds = current = firsts(visits)
    while True:
        visits = after(visits, current)
        if visits.isEmpty():
            return rounds
        current = firsts(visits)
        rounds = rounds.unionByName(current)


# --- reading and editing the log -------------------------------------------------------------------


def list_logs(log: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limit of 0 or less means all."""
    ordered = log.orderBy(F.desc("created_us"), "doc_id")
    return ordered.limit(limit) if limit and limit > 0 else ordered


def update_logs(log: DataFrame, updates: DataFrame, as_of_us: Column, order: str | None = None) -> DataFrame:
    """Apply ``updates(doc_id, pred, is_verified)`` and stamp updated_us; NULL means unchanged.

    Several updates of one id are applied in the rising order of the column ``order``: each field
    gets its last value. Without such a column, or on a tie, the larger value is the last one.
    """
    at = F.col(order) if order else F.lit(0)

    def last(column: str) -> Column:
        return F.max(F.when(F.col(column).isNotNull(), F.struct(at.alias("at"), F.col(column).alias("value"))))["value"]

    changes = (
        updates.filter("doc_id IS NOT NULL AND (pred IS NOT NULL OR is_verified IS NOT NULL)")
        .groupBy("doc_id")
        .agg(last("pred").alias("_pred"), last("is_verified").alias("_verified"))
        .withColumn("_at", as_of_us)
    )
    for column, dtype in [("is_verified", "boolean"), ("updated_us", "bigint")]:
        if column not in log.columns:
            log = log.withColumn(column, F.lit(None).cast(dtype))
    return (
        log.join(changes, "doc_id", "left")
        .withColumns(
            {
                "pred": F.coalesce("_pred", "pred"),
                "is_verified": F.coalesce("_verified", "is_verified"),
                "updated_us": F.coalesce("_at", "updated_us"),
            }
        )
        .drop("_pred", "_verified", "_at")
    )


def update_errors(log: DataFrame, updates: DataFrame) -> DataFrame:
    """doc_id, error of the updates that cannot be applied."""
    nothing = F.col("pred").isNull() & F.col("is_verified").isNull()
    # fixed values: the two messages
    empty = updates.filter(nothing).select("doc_id", F.lit("No valid fields to update").alias("error"))
    unknown = (
        updates.filter(~nothing)
        .join(log.select("doc_id"), "doc_id", "left_anti")
        .select("doc_id", F.lit("Failed to update").alias("error"))
    )
    return empty.unionByName(unknown)


def delete_logs(log: DataFrame, deletes: DataFrame) -> DataFrame:
    return log.join(deletes.select("doc_id"), "doc_id", "left_anti")


def search_logs(
    log: DataFrame, model: str | None = None, text: str | None = None,
    sort_by: str = "created_us", descending: bool = True,
) -> DataFrame:
    """Filter by model and by a piece of url, model or id (any case); sort by any column."""
    found = log
    if model:
        found = found.filter(F.col("model") == model)
    if text:
        shown = F.coalesce(F.nullif("original_url", F.lit("")), "url", F.lit(""))
        hit = F.lit(False)
        for column in (shown, F.col("model"), F.col("doc_id")):
            hit = hit | F.lower(F.coalesce(column, F.lit(""))).contains(text.lower())
        found = found.filter(hit)
    key = F.col(sort_by)
    if dict(log.dtypes)[sort_by] == "string":
        key = F.lower(key)
    return found.orderBy(key.desc() if descending else key.asc(), "doc_id")


def page_of(rows: DataFrame, page: int, size: int = PAGE_SIZE) -> DataFrame:
    """The 1-based page of ordered rows."""
    return rows.offset((page - 1) * size).limit(size)


def page_after(log: DataFrame, last: Row | None, size: int = PAGE_SIZE) -> DataFrame:
    """The page behind the row ``last`` of :func:`list_logs`, or the first one.

    The rows before it are filtered out instead of being skipped, so a late page costs no more than
    the first and nothing but one page is gathered.
    """
    if last is not None:
        same = F.col("created_us") == last["created_us"]
        log = log.filter((F.col("created_us") < last["created_us"]) | (same & (F.col("doc_id") > last["doc_id"])))
    return list_logs(log, size)


def page_count(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """One row: pages, at least 1."""
    return rows.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("pages"))


def models_in(log: DataFrame) -> DataFrame:
    return log.filter("model IS NOT NULL AND model != ''").select("model").distinct().orderBy("model")


def verdict_totals(log: DataFrame) -> DataFrame:
    """phishing (pred 0) and benign (the rest)."""
    phishing = F.coalesce(F.sum((F.col("pred") == 0).cast("long")), F.lit(0))
    return log.agg(phishing.alias("phishing"), (F.count("*") - phishing).alias("benign"))
