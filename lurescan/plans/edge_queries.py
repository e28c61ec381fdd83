"""Operators on NULL classes, splits and labels, on repeated updates and on a scorer that fails."""

from pyspark.sql import functions as F

from lurescan.operators import clean as B
from lurescan.operators import evaluate as K
from lurescan.operators import predlog as M
from lurescan.operators import sampling as S
from lurescan.plans import serving_queries as Q
from lurescan.plans.registry import Tables, query
from lurescan.streaming import visits as N

GAPS_SQL = """
rows_of AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN quality END AS label,
  CASE WHEN doc_id % 5 > 1 THEN 's' || (doc_id % 5) END AS split, md5(doc_id || ':42') AS h FROM labels)
"""


def gaps(t: Tables):
    """Labels of which a third is NULL, with splits of which two fifths are NULL."""
    key = F.col("doc_id")
    return t.labels.select(
        "doc_id",
        F.when(key % 3 > 0, F.col("quality")).alias("label"),
        F.when(key % 5 > 1, F.concat(F.lit("s"), (key % 5).cast("string"))).alias("split"),
    )


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS rn, count(*) OVER (PARTITION BY label) AS n FROM rows_of)"


@query(
    "split_with_null_class",
    "doc_id:i label:i split:s",
    f"""WITH {GAPS_SQL} SELECT doc_id, label, CASE WHEN rn <= floor(0.2 * n + 0.5) THEN 'test' ELSE 'train' END AS split
    FROM {_RANKED}""",
)
def split_with_null_class(t: Tables):
    return S.stratified_split(gaps(t).drop("split"), "doc_id")


@query(
    "sample_with_null_class",
    "doc_id:i label:i",
    f"WITH {GAPS_SQL} SELECT doc_id, label FROM {_RANKED} WHERE rn <= 9",
)
def sample_with_null_class(t: Tables):
    return S.sample_up_to(gaps(t), "doc_id", 9)


@query(
    "distribution_with_null_split",
    "split:s label:i n:i share:d",
    f"""WITH {GAPS_SQL} SELECT split, label, count(*) AS n,
      count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM rows_of GROUP BY split, label""",
)
def distribution_with_null_split(t: Tables):
    return B.class_distribution(gaps(t))


@query(
    "histogram_with_null_label",
    "label:i bin:i n:i",
    f"""WITH {GAPS_SQL}, scores AS (SELECT label, (n_chars % 500) / 500 AS score FROM rows_of JOIN documents USING (doc_id)),
    r AS (SELECT label, min(score) AS lo, max(score) - min(score) AS width FROM scores GROUP BY label),
    c AS (SELECT s.label, least(floor((score - lo) / width * 50), 49) AS bin, count(*) AS n
          FROM scores s JOIN r ON s.label IS NOT DISTINCT FROM r.label GROUP BY 1, 2),
    g AS (SELECT label, unnest(range(50)) AS bin FROM r)
    SELECT g.label, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON g.label IS NOT DISTINCT FROM c.label AND g.bin = c.bin""",
)
def histogram_with_null_label(t: Tables):
    score = ((F.col("n_chars") % 500) / 500).alias("score")
    return K.score_histogram(gaps(t).join(t.documents.select("doc_id", score), "doc_id"))


@query(
    "mismatch_with_null_label",
    "url:s label_first:i label_second:i",
    f"""WITH {GAPS_SQL} SELECT 'd' || doc_id AS url, rows_of.label AS label_first, quality AS label_second
    FROM rows_of JOIN labels USING (doc_id) WHERE rows_of.label IS DISTINCT FROM quality""",
)
def mismatch_with_null_label(t: Tables):
    url = F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("url")
    first = gaps(t).select(url, "label")
    return B.label_mismatch_report(first, t.labels.select(url, F.col("quality").alias("label")))


@query(
    "repeated_updates",
    "doc_id:s pred:i is_verified:i updated_us:i",
    f"""WITH {Q.NORMALISED_SQL}, {Q.LOG_SQL}
    SELECT doc_id, CASE WHEN model = 'xgb' THEN 1 - pred WHEN model = 'rf' THEN pred ELSE pred END AS pred,
      CASE WHEN model = 'xgb' THEN 1 WHEN model = 'rf' THEN 0 END AS is_verified,
      CASE WHEN model IN ('xgb', 'rf') THEN {Q.CUTOFF_US} END AS updated_us FROM log""",
)
def repeated_updates(t: Tables):
    """XGB rows get two fields one after the other, RF rows one field twice; the last value counts."""
    log = Q.existing_log(t)
    xgb, rf = F.col("model") == "xgb", F.col("model") == "rf"
    none, verified = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    steps = [
        (1, F.when(xgb, F.col("pred")).otherwise(none), F.when(rf, True).otherwise(verified)),
        (2, F.when(xgb, 1 - F.col("pred")).otherwise(none), F.when(xgb, True).when(rf, False)),
    ]
    updates = None
    for number, pred, flag in steps:
        part = log.select("doc_id", pred.alias("pred"), flag.alias("is_verified"), F.lit(number).alias("step"))
        updates = part if updates is None else updates.unionByName(part)
    return M.update_logs(log, updates, Q.cutoff(), order="step")


FAILS_SQL = "substr(md5(url || '|' || model), 1, 1) < '5'"


def failing_scorer(requests):
    """A model that gives no result for some URLs."""
    scored = Q.hash_scorer(requests)
    fails = F.substring(F.md5(F.concat_ws("|", "url", "model")), 1, 1) < "5"
    return scored.withColumn("proba", F.when(~fails, F.col("proba")))


@query(
    "responses_of_a_failing_scorer",
    "request_id:i pred:i proba:d cached:i error:s",
    f"""WITH {Q.NORMALISED_SQL}, {Q.LOG_SQL},
    v AS (SELECT doc_id, pred, proba, NULL AS by_id FROM live
      UNION ALL SELECT doc_id, pred, proba, request_id FROM added WHERE NOT {FAILS_SQL})
    SELECT r.request_id, v.pred, v.proba,
      CASE WHEN r.error IS NULL AND v.pred IS NOT NULL THEN CASE WHEN v.by_id IS NULL OR v.by_id <> r.request_id THEN 1 ELSE 0 END END AS cached,
      CASE WHEN r.error IS NULL AND v.pred IS NULL THEN 'Scoring failed' ELSE r.error END AS error
    FROM requests r LEFT JOIN v ON r.doc_id = v.doc_id WHERE r.ts_us >= {Q.CUTOFF_US}""",
)
def responses_of_a_failing_scorer(t: Tables):
    log, requests = Q.existing_log(t), Q.new_requests(t)
    new_rows = M.rows_to_score(requests, log, failing_scorer, Q.cutoff(), Q.TTL)
    return M.responses(requests, log, new_rows, Q.cutoff(), Q.TTL)


@query(
    "verdicts_of_a_failing_scorer",
    "request_id:i badge:s pred:i is_phishing:i error:s",
    f"""WITH RECURSIVE {Q.VISITS_SQL}, {Q.SCHEDULE_SQL}, {Q.VERDICTS_SQL},
    answered AS (SELECT s.doc_id, s.ts_us, {FAILS_SQL.replace("url", "u.url").replace("model", "u.model")} AS failed
      FROM schedule s JOIN ordered o ON s.doc_id = o.doc_id AND s.ts_us = o.ts_us JOIN usable u ON u.request_id = o.request_id),
    seen AS (SELECT v.*, coalesce(a.failed, FALSE) AS failed FROM verdicts v JOIN visits i USING (request_id)
      LEFT JOIN answered a ON v.is_web = 1 AND v.error IS NULL AND a.doc_id = i.doc_id
        AND v.ts_us BETWEEN a.ts_us AND a.ts_us + {Q.TTL * 1_000_000})
    SELECT request_id, CASE WHEN failed THEN 'ERR' ELSE badge END AS badge, CASE WHEN NOT failed THEN pred END AS pred,
      CASE WHEN is_web = 1 AND error IS NULL AND NOT failed THEN 1 - pred END AS is_phishing,
      CASE WHEN failed THEN 'Scoring failed' ELSE error END AS error FROM seen""",
)
def verdicts_of_a_failing_scorer(t: Tables):
    visits = Q.as_visits(t, t.events)
    return N.serve_batch(visits, None, failing_scorer, Q.MODELS, Q.TTL, lambda rows: rows)
