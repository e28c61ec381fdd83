"""Prediction cache, log and visits. Requests are events on the page that their ``k`` names."""

import uuid
from collections.abc import Iterable

from pyspark.sql import functions as F

from lurescan.operators import predlog as M
from lurescan.operators import scoring as J
from lurescan.operators.tables import shared_folder
from lurescan.plans.dataset_queries import hash_number, hash_sql
from lurescan.plans.registry import Tables, query
from lurescan.sources.keyed import KeyedLog
from lurescan.streaming import state as K
from lurescan.streaming import visits as N

MODELS = ["xgb", "rf", "albert", "mobile_bert"]
TTL = 7 * 86_400
CUTOFF_US = 1_705_708_800_000_000  # 2024-01-20 00:00 UTC


def micros(df, column: str):
    """Microseconds since 1970 of a UTC wall-clock column, whatever the session time zone."""
    if dict(df.dtypes)[column] == "timestamp":
        return F.unix_micros(column)
    since = f"({column} - timestamp_ntz'1970-01-01 00:00:00')"
    seconds = F.expr(f"cast(cast({since} as interval second) as decimal(20, 6))")
    return (seconds * 1_000_000).cast("bigint")


def hash_scorer(requests):
    """Stand-in for a model: probability from the md5 of url and model."""
    coded = requests.withColumn("_code", F.concat_ws("|", "url", "model"))
    return coded.withColumn("proba", hash_number("_code", 1, 6) / 16777216).drop("_code")


def visited_pages(t: Tables, events):
    page = F.get_json_object("props", "$.k").cast("bigint")
    pages = t.pages.select(F.col("page_id").alias("_page"), "url")
    return events.withColumn("_page", page).join(pages, "_page", "left").drop("_page")


def all_requests(t: Tables):
    events = t.events
    kind, value = F.col("event_type"), F.col("value")
    model = (
        F.when(kind == "click", "rf").when(kind == "view", "XGB").when(kind == "signup", "albert")
        .when(kind == "error", "no_such_model")
    )
    return visited_pages(t, events.withColumn("ts_us", micros(events, "ts"))).select(
        F.col("event_id").alias("request_id"),
        "ts_us",
        F.concat(F.lit(" "), "url").alias("url"),
        model.alias("model"),
        F.when(value < 20, value / 20).alias("threshold"),
        F.when(value > 50, "domain").alias("scan_mode"),
    )


def normalised(t: Tables):
    return M.normalise_requests(all_requests(t), MODELS)


def new_requests(t: Tables):
    return normalised(t).filter(F.col("ts_us") >= CUTOFF_US)


def existing_log(t: Tables):
    """Log of the requests before the cutoff: every key at its first request, last write wins."""
    past = normalised(t).filter((F.col("ts_us") < CUTOFF_US) & F.col("error").isNull())
    firsts = M.first_requests(
        past, "ts_us",
        ["request_id", "ts_us", "url", "original_url", "model", "threshold"],
    )
    return M.score_requests(firsts, hash_scorer, F.col("ts_us")).drop("request_id")


NORMALISED_SQL = f"""
asked AS (
  SELECT event_id AS request_id, epoch_us(ts) AS ts_us, coalesce(p.url, '') AS given,
    CASE event_type WHEN 'click' THEN 'rf' WHEN 'view' THEN 'xgb' WHEN 'signup' THEN 'albert'
                    WHEN 'error' THEN 'no_such_model' ELSE 'xgb' END AS model,
    CASE WHEN value < 20 THEN value / 20 ELSE 0.5 END AS threshold,
    CASE WHEN value > 50 THEN 'domain' ELSE 'full' END AS scan_mode
  FROM events LEFT JOIN pages p ON p.page_id = CAST(json_extract_string(props, '$.k') AS BIGINT)),
scanned AS (
  SELECT *, CASE WHEN given = '' THEN 'Missing ''url''' WHEN model = 'no_such_model' THEN 'Unknown model ''no_such_model''' END AS error,
    CASE WHEN given = '' THEN CASE WHEN scan_mode = 'domain' THEN '://' ELSE '' END
         WHEN scan_mode = 'domain' THEN regexp_extract(given, '^([a-z]+://[^/?#]*)', 1) ELSE given END AS url FROM asked),
requests AS (
  SELECT *, CASE WHEN error IS NULL THEN sha256(lower(regexp_extract(given, '^[a-z]+://([^/?#]*)', 1))) || ':' || model || '_' || scan_mode END AS doc_id
  FROM scanned),
scored AS (SELECT *, {hash_sql("url || '|' || model", 1, 6)} / 16777216 AS proba FROM requests)
"""

LOG_SQL = f"""
log AS (SELECT doc_id, url, given AS original_url, model, CASE WHEN proba >= threshold THEN 1 ELSE 0 END AS pred, proba, ts_us AS created_us
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts_us, request_id) AS rn FROM scored
        WHERE ts_us < {CUTOFF_US} AND error IS NULL) WHERE rn = 1),
live AS (SELECT * FROM log WHERE {CUTOFF_US} - created_us <= {TTL * 1_000_000}),
fresh AS (SELECT s.*, row_number() OVER (PARTITION BY s.doc_id ORDER BY request_id) AS rn FROM scored s
  WHERE ts_us >= {CUTOFF_US} AND error IS NULL AND doc_id NOT IN (SELECT doc_id FROM live)),
added AS (SELECT doc_id, url, given AS original_url, model, CASE WHEN proba >= threshold THEN 1 ELSE 0 END AS pred, proba, request_id FROM fresh WHERE rn = 1)
"""

LOG_SPEC = "doc_id:s url:s original_url:s model:s pred:i proba:d created_us:i"


def cutoff():
    return F.lit(CUTOFF_US)


@query(
    "normalised_requests",
    "request_id:i url:s original_url:s model:s threshold:d scan_mode:s error:s",
    f"WITH {NORMALISED_SQL} SELECT *, given AS original_url FROM requests",
)
def normalised_requests(t: Tables):
    return normalised(t)


@query(
    "cached_responses",
    "request_id:i url:s original_url:s pred:i proba:d cached:i error:s",
    f"""WITH {NORMALISED_SQL}, {LOG_SQL},
    v AS (SELECT doc_id, pred, proba, NULL AS by_id FROM live UNION ALL SELECT doc_id, pred, proba, request_id FROM added)
    SELECT r.request_id, r.url, r.given AS original_url, v.pred, v.proba,
      CASE WHEN r.error IS NULL THEN CASE WHEN v.by_id IS NULL OR v.by_id <> r.request_id THEN 1 ELSE 0 END END AS cached, r.error
    FROM requests r LEFT JOIN v ON r.doc_id = v.doc_id WHERE r.ts_us >= {CUTOFF_US}""",
)
def cached_responses(t: Tables):
    return M.answered_requests(new_requests(t), existing_log(t), hash_scorer, cutoff(), TTL)[0]


@query(
    "log_after_scoring",
    LOG_SPEC,
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}
    SELECT doc_id, url, original_url, model, pred, proba, {CUTOFF_US} AS created_us FROM added
    UNION ALL SELECT * FROM log WHERE doc_id NOT IN (SELECT doc_id FROM added)""",
)
def log_after_scoring(t: Tables):
    log = existing_log(t)
    new_rows = M.rows_to_score(new_requests(t), log, hash_scorer, cutoff(), TTL)
    return M.upsert(log, new_rows.drop("request_id"))


#: Folders of the keyed log in the queries.
BUCKETS = 32


def keyed_log(t: Tables) -> KeyedLog:
    """The existing log in a folder of its own."""
    log = KeyedLog(t.spark, run_folder(t, "log"), BUCKETS)
    log.put(existing_log(t))
    return log


@query(
    "keyed_log_after_scoring",
    LOG_SPEC,
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}
    SELECT doc_id, url, original_url, model, pred, proba, {CUTOFF_US} AS created_us FROM added
    UNION ALL SELECT * FROM log WHERE doc_id NOT IN (SELECT doc_id FROM added)""",
)
def keyed_log_after_scoring(t: Tables):
    log, requests = keyed_log(t), new_requests(t)
    known = log.rows_of(requests.filter("error IS NULL"))
    log.put(M.rows_to_score(requests, known, hash_scorer, cutoff(), TTL))
    return log.rows()


@query(
    "keyed_log_after_edits",
    LOG_SPEC + " is_verified:i updated_us:i",
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}, edited AS (
      SELECT doc_id, url, original_url, model, CASE WHEN ends_with(doc_id, '_domain') THEN 1 - pred ELSE pred END AS pred, proba, created_us,
        CASE WHEN model = 'xgb' THEN 1 END AS is_verified,
        CASE WHEN model = 'xgb' OR ends_with(doc_id, '_domain') THEN {CUTOFF_US} END AS updated_us FROM log)
    SELECT * FROM edited WHERE NOT (pred = 0 AND model <> 'rf') AND {CUTOFF_US} - created_us <= {TTL} * 1000000::BIGINT""",
)
def keyed_log_after_edits(t: Tables):
    log = keyed_log(t)
    log.update(updates(t), cutoff())
    log.delete(log.rows().filter("pred = 0 AND model <> 'rf'"))
    log.expire(CUTOFF_US, TTL)
    return log.rows()


@query("live_log_rows", LOG_SPEC, f"WITH {NORMALISED_SQL}, {LOG_SQL} SELECT * FROM live")
def live_log_rows(t: Tables):
    return M.live_rows(existing_log(t), cutoff(), TTL)


@query(
    "newest_logs",
    LOG_SPEC,
    f"WITH {NORMALISED_SQL}, {LOG_SQL} SELECT * FROM log ORDER BY created_us DESC, doc_id LIMIT 25",
)
def newest_logs(t: Tables):
    return M.list_logs(existing_log(t), 25)


@query(
    "page_after_a_row",
    LOG_SPEC,
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}
    SELECT * FROM log ORDER BY created_us DESC, doc_id LIMIT 10 OFFSET 25""",
)
def page_after_a_row(t: Tables):
    log = existing_log(t)
    last = M.list_logs(log, 25).collect()[-1]
    return M.page_after(log, last)


# Reviews of the log: domain-mode rows are corrected, XGB rows verified, RF rows named without change.
def updates(t: Tables):
    domain = F.col("doc_id").endswith("_domain")
    known = existing_log(t).select(
        "doc_id",
        F.when(domain, 1 - F.col("pred")).alias("pred"),
        F.when(F.col("model") == "xgb", True).alias("is_verified"),
    )
    unknown = t.benchmark.select(
        F.md5("text").alias("doc_id"), F.lit(1).alias("pred"), F.lit(None).cast("boolean").alias("is_verified")
    )
    return known.unionByName(unknown)


@query(
    "updated_logs",
    "doc_id:s pred:i is_verified:i updated_us:i",
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}
    SELECT doc_id, CASE WHEN doc_id LIKE '%\\_domain' ESCAPE '\\' THEN 1 - pred ELSE pred END AS pred,
      CASE WHEN model = 'xgb' THEN 1 END AS is_verified,
      CASE WHEN model = 'xgb' OR doc_id LIKE '%\\_domain' ESCAPE '\\' THEN {CUTOFF_US} END AS updated_us FROM log""",
)
def updated_logs(t: Tables):
    return M.update_logs(existing_log(t), updates(t), cutoff())


@query(
    "update_errors",
    "doc_id:s error:s",
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}
    SELECT doc_id, 'No valid fields to update' AS error FROM log WHERE model <> 'xgb' AND NOT doc_id LIKE '%\\_domain' ESCAPE '\\'
    UNION ALL SELECT md5(text), 'Failed to update' FROM benchmark""",
)
def update_errors(t: Tables):
    return M.update_errors(existing_log(t), updates(t))


@query(
    "deleted_logs",
    LOG_SPEC,
    f"WITH {NORMALISED_SQL}, {LOG_SQL} SELECT * FROM log WHERE pred <> 0 OR model = 'rf'",
)
def deleted_logs(t: Tables):
    log = existing_log(t)
    return M.delete_logs(log, log.filter("pred = 0 AND model <> 'rf'"))


@query(
    "searched_logs",
    LOG_SPEC,
    f"""WITH {NORMALISED_SQL}, {LOG_SQL} SELECT * FROM log WHERE model = 'xgb' AND
    (contains(lower(original_url), 'www') OR contains(model, 'www') OR contains(doc_id, 'www'))
    ORDER BY lower(url), doc_id LIMIT 10 OFFSET 10""",
)
def searched_logs(t: Tables):
    found = M.search_logs(existing_log(t), "xgb", "WWW", "url", descending=False)
    return M.page_of(found, 2)


@query(
    "log_totals",
    "phishing:i benign:i pages:i models:s",
    f"""WITH {NORMALISED_SQL}, {LOG_SQL}
    SELECT sum(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS phishing, sum(CASE WHEN pred = 0 THEN 0 ELSE 1 END) AS benign,
      greatest(ceil(count(*) / 10), 1) AS pages, (SELECT string_agg(model, ',' ORDER BY model) FROM (SELECT DISTINCT model FROM log)) AS models FROM log""",
)
def log_totals(t: Tables):
    log = existing_log(t)
    models = M.models_in(log).agg(F.array_join(F.array_sort(F.collect_set("model")), ",")).scalar()
    return M.verdict_totals(log).withColumns(
        {"pages": M.page_count(log).scalar(), "models": models}
    )


# --- decision rules --------------------------------------------------------------------------------


@query(
    "decision_rules",
    "vec_id:i at_threshold:i evaluated:i argmax_class:i argmax_proba:d answer_class:i answer_proba:d",
    f"""WITH r AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, {hash_sql("vec_id::VARCHAR", 1, 4)} / 65536 AS proba,
      CASE substr(md5(vec_id::VARCHAR), 1, 1) WHEN '0' THEN 'Phishing.' WHEN '1' THEN ' benign?' WHEN '2' THEN 'PHish' ELSE 'maybe' END AS answer FROM embeddings)
    SELECT vec_id, CASE WHEN proba >= 0.25 THEN 1 ELSE 0 END AS at_threshold, CASE WHEN proba > 0.5 THEN 1 ELSE 0 END AS evaluated,
      CASE WHEN b > a THEN 1 ELSE 0 END AS argmax_class, greatest(exp(a), exp(b)) / (exp(a) + exp(b)) AS argmax_proba,
      CASE WHEN answer = ' benign?' THEN 1 ELSE 0 END AS answer_class, CASE WHEN answer = 'maybe' THEN 0 ELSE 0.95 END AS answer_proba FROM r""",
)
def decision_rules(t: Tables):
    rows = t.embeddings.withColumn("_id", F.col("vec_id").cast("string"))
    proba = hash_number("_id", 1, 4) / 65536
    digit = F.substring(F.md5("_id"), 1, 1)
    answer = (
        F.when(digit == "0", "Phishing.").when(digit == "1", " benign?").when(digit == "2", "PHish")
        .otherwise("maybe")
    )
    logits = F.slice("embedding", 1, 2).cast("array<double>")
    (argmax_class, argmax_proba), (answer_class, answer_proba) = J.argmax_pred(logits), J.answer_pred(answer)
    return rows.select(
        "vec_id",
        J.threshold_pred(proba, 0.25).alias("at_threshold"),
        J.evaluation_pred(proba).alias("evaluated"),
        argmax_class.alias("argmax_class"),
        argmax_proba.alias("argmax_proba"),
        answer_class.alias("answer_class"),
        answer_proba.alias("answer_proba"),
    )


def make_logistic():
    """Loads the stand-in for an external model: a fixed linear layer."""
    import numpy as np

    def predict(batch):
        weights = np.linspace(-1.0, 1.0, batch.shape[1])
        return 1.0 / (1.0 + np.exp(-(batch.astype("float64") @ weights)))

    return predict


@query(
    "external_scores",
    "vec_id:i proba:d pred:i",
    """WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
    s AS (SELECT vec_id, 1 / (1 + exp(-sum(x * (-1 + 2 * i / 63)))) AS proba FROM p GROUP BY vec_id)
    SELECT vec_id, proba, CASE WHEN proba >= 0.5 THEN 1 ELSE 0 END AS pred FROM s""",
)
def external_scores(t: Tables):
    scored = J.score_external(t.embeddings, make_logistic, ["embedding"], [[64]])
    return scored.withColumn("pred", J.threshold_pred(F.col("proba"), 0.5))


def make_scaled(factor: float):
    """Loader of a stand-in model: the linear layer of :func:`make_logistic` with other weights."""
    def load():
        import numpy as np

        def predict(batch):
            weights = np.linspace(-1.0, 1.0, batch.shape[1]) * factor
            return 1.0 / (1.0 + np.exp(-(batch.astype("float64") @ weights)))

        return predict

    return load


@query(
    "external_scores_by_model",
    "vec_id:i model:s proba:d",
    """WITH p AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings),
    s AS (SELECT vec_id, sum(x * (-1 + 2 * i / 63)) AS m FROM p GROUP BY vec_id)
    SELECT vec_id, model, 1 / (1 + exp(-m * f)) AS proba FROM s, (VALUES ('albert', 1.0), ('rf', -0.5), ('xgb', 2.0)) v(model, f)""",
)
def external_scores_by_model(t: Tables):
    loaders = {"albert": make_scaled(1.0), "rf": make_scaled(-0.5), "xgb": make_scaled(2.0), "unused": make_scaled(0.0)}
    return J.score_external_models(t.embeddings, loaders, ["albert", "rf", "xgb"], ["embedding"], [[64]])


@query(
    "scores_by_model",
    "page_id:i model:s proba:d",
    f"""SELECT page_id, model, {hash_sql("url || '|' || model", 1, 6)} / 16777216 AS proba
    FROM pages, (SELECT unnest(['albert', 'rf', 'xgb']) AS model) m""",
)
def scores_by_model(t: Tables):
    def scorer(name: str):
        return lambda df: hash_scorer(df.withColumn("model", F.lit(name))).drop("model")

    scorers = {name: scorer(name) for name in MODELS}
    return J.score_models(t.pages.select("page_id", "url"), scorers, ["albert", "rf", "xgb"])


def trainable(t: Tables):
    return t.embeddings.select(
        "vec_id", F.col("embedding").alias("vector"), (F.col("label") % 2).cast("double").alias("label")
    )


@query("random_forest_scores", "vec_id:i label:i pred:i proba:d")
def random_forest_scores(t: Tables):
    rows = trainable(t)
    return J.score_with(J.fit_random_forest(rows), rows)


@query("boosted_tree_scores", "vec_id:i label:i pred:i proba:d")
def boosted_tree_scores(t: Tables):
    rows = trainable(t)
    return J.score_with(J.fit_boosted_trees(rows), rows)


@query("linear_margin_scores", "vec_id:i label:i pred:i proba:d")
def linear_margin_scores(t: Tables):
    rows = trainable(t)
    return J.score_with(J.fit_linear_margin(rows), rows)


@query("top_importances", "feature:s importance:d")
def top_importances(t: Tables):
    from lurescan.operators.evaluate import top_importances as top

    rows = trainable(t)
    return top(J.feature_importances(J.fit_random_forest(rows), rows), 10)


# --- visits ----------------------------------------------------------------------------------------


def as_visits(t: Tables, events):
    """Visits: the user is the tab; sign-ups open an internal page; purchases have no threshold."""
    kind, value = F.col("event_type"), F.col("value")
    address = F.when(kind == "signup", F.concat(F.lit("chrome://"), "url")).otherwise(
        F.concat(F.upper(F.substring("url", 1, 1)), F.expr("substring(url, 2)"))
    )
    return visited_pages(t, events.withColumn("ts_us", micros(events, "ts"))).select(
        F.col("event_id").alias("request_id"),
        F.col("user_id").alias("tab_id"),
        "ts_us",
        address.alias("url"),
        F.when(kind == "error", "no_such_model").when(kind == "click", "xgb").alias("model"),
        F.when(kind == "purchase", F.lit(float("nan"))).otherwise(value / 10 - 1).alias("threshold"),
        F.when(value > 50, "domain").alias("scan_mode"),
    )


#: Quarters of the time span, each a micro-batch, and the files of each.
QUARTERS, QUARTER_FILES = 4, 4


def write_quarters(t: Tables, folder: str, quarters: Iterable[int]) -> None:
    """Append quarters of the events' time span to a folder, :data:`QUARTER_FILES` files each."""
    at = micros(t.events, "ts")
    span = t.events.agg(F.min(at).alias("low"), F.max(at).alias("high")).first()
    place = F.floor((at - span["low"]) * QUARTERS / (span["high"] - span["low"] + 1))
    for k in quarters:
        rows = t.events.filter(F.least(place, F.lit(QUARTERS - 1)) == k)
        rows.repartition(QUARTER_FILES).write.mode("append").parquet(folder)


def read_quarters(t: Tables, folder: str):
    return t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", QUARTER_FILES).parquet(folder)


def event_stream(t: Tables):
    """The events as a file stream, a quarter of the time span per batch."""
    folder = run_folder(t, "events")
    write_quarters(t, folder, range(QUARTERS))
    return read_quarters(t, folder)


def run_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


VISITS_SQL = f"""
raw_visits AS (
  SELECT event_id AS request_id, user_id AS tab_id, epoch_us(ts) AS ts_us, p.url AS page,
    CASE WHEN p.url IS NULL THEN '' WHEN event_type = 'signup' THEN 'chrome://' || p.url ELSE 'H' || substr(p.url, 2) END AS given,
    CASE event_type WHEN 'error' THEN 'no_such_model' WHEN 'click' THEN 'xgb' ELSE 'rf' END AS model,
    CASE WHEN event_type = 'purchase' THEN 0.6 ELSE least(greatest(value / 10 - 1, 0), 1) END AS threshold,
    CASE WHEN value > 50 THEN 'domain' ELSE 'full' END AS scan_mode
  FROM events LEFT JOIN pages p ON p.page_id = CAST(json_extract_string(props, '$.k') AS BIGINT)),
scan AS (
  SELECT *, regexp_extract(page, '^[a-z]+://([^/?#]*)', 1) AS site,
    CASE WHEN given = '' THEN 'Missing ''url''' WHEN model = 'no_such_model' THEN 'Unknown model ''no_such_model''' END AS error,
    CASE WHEN given = '' THEN CASE WHEN scan_mode = 'domain' THEN '://' ELSE '' END
         WHEN scan_mode = 'full' THEN given
         WHEN starts_with(given, 'chrome') THEN 'chrome://' || regexp_extract(page, '^([a-z]+:)', 1)
         ELSE regexp_extract(page, '^([a-z]+://[^/?#]*)', 1) END AS url FROM raw_visits),
visits AS (
  SELECT *, CASE WHEN regexp_matches(lower(url), '^https?://') THEN 1 ELSE 0 END AS is_web,
    sha256(site) || ':' || model || '_' || scan_mode AS doc_id FROM scan),
usable AS (SELECT * FROM visits WHERE is_web = 1 AND error IS NULL)
"""

SCHEDULE_SQL = f"""
ordered AS (SELECT doc_id, ts_us, min(request_id) AS request_id FROM usable GROUP BY doc_id, ts_us),
schedule AS (
  SELECT doc_id, min(ts_us) AS ts_us FROM ordered GROUP BY doc_id
  UNION ALL
  SELECT * FROM (SELECT s.doc_id, (SELECT min(o.ts_us) FROM ordered o WHERE o.doc_id = s.doc_id AND o.ts_us > s.ts_us + {TTL * 1_000_000}) AS ts_us FROM schedule s) WHERE ts_us IS NOT NULL)
"""


@query(
    "scoring_schedule",
    "doc_id:s ts_us:i request_id:i",
    f"WITH RECURSIVE {VISITS_SQL}, {SCHEDULE_SQL} SELECT s.doc_id, s.ts_us, o.request_id FROM schedule s JOIN ordered o ON s.doc_id = o.doc_id AND s.ts_us = o.ts_us",
)
def scoring_schedule(t: Tables):
    gated = N.configured(as_visits(t, t.events), MODELS)
    usable = gated.filter(N.is_web_url(F.col("url")) & F.col("error").isNull())
    return M.scoring_schedule(usable.select("doc_id", "request_id", "ts_us"), None, TTL)


@query(
    "scoring_schedule_by_state",
    "doc_id:s ts_us:i request_id:i",
    f"WITH RECURSIVE {VISITS_SQL}, {SCHEDULE_SQL} SELECT s.doc_id, s.ts_us, o.request_id FROM schedule s JOIN ordered o ON s.doc_id = o.doc_id AND s.ts_us = o.ts_us",
)
def scoring_schedule_by_state(t: Tables):
    """Half of the batches, then a new query on the same checkpoint for the rest."""
    events, folder = run_folder(t, "events"), run_folder(t, "schedule")
    for quarters in (range(QUARTERS // 2), range(QUARTERS // 2, QUARTERS)):
        write_quarters(t, events, quarters)
        gated = N.configured(as_visits(t, read_quarters(t, events)), MODELS)
        usable = gated.filter(N.is_web_url(F.col("url")) & F.col("error").isNull())
        K.run_schedule(usable, folder, TTL).awaitTermination()
    return K.scheduled(t.spark, folder)


VERDICTS_SQL = f"""
rows_scored AS (
  SELECT s.doc_id, s.ts_us AS created_us, u.request_id AS scored_by, {hash_sql("u.url || '|' || u.model", 1, 6)} / 16777216 AS proba, u.threshold
  FROM schedule s JOIN ordered o ON s.doc_id = o.doc_id AND s.ts_us = o.ts_us JOIN usable u ON u.request_id = o.request_id),
verdicts AS (
  SELECT v.request_id, v.tab_id, v.ts_us, v.url, v.is_web, v.error, CASE WHEN r.proba >= r.threshold THEN 1 WHEN r.proba IS NOT NULL THEN 0 END AS pred, r.proba,
    CASE WHEN r.proba IS NOT NULL THEN CASE WHEN r.scored_by <> v.request_id THEN 1 ELSE 0 END END AS cached,
    CASE WHEN v.is_web = 0 THEN '' WHEN v.error IS NOT NULL THEN 'ERR' WHEN r.proba >= r.threshold THEN 'OK' ELSE 'P' END AS badge
  FROM visits v LEFT JOIN rows_scored r ON v.is_web = 1 AND v.error IS NULL AND v.doc_id = r.doc_id
    AND v.ts_us BETWEEN r.created_us AND r.created_us + {TTL * 1_000_000})
"""


def stream_verdicts(t: Tables):
    folder = run_folder(t, "visits")
    running = N.run_visits(as_visits(t, event_stream(t)), folder, hash_scorer, MODELS, TTL)
    running.awaitTermination()
    return t.spark.read.parquet(f"{folder}/verdicts").drop("batch_id")


VERDICT_SPEC = "request_id:i tab_id:i ts_us:i url:s is_web:i error:s pred:i proba:d cached:i badge:s"


@query(
    "visit_verdicts",
    VERDICT_SPEC,
    f"WITH RECURSIVE {VISITS_SQL}, {SCHEDULE_SQL}, {VERDICTS_SQL} SELECT * FROM verdicts",
)
def visit_verdicts(t: Tables):
    return stream_verdicts(t)


@query(
    "latest_verdict_per_tab",
    VERDICT_SPEC,
    f"""WITH RECURSIVE {VISITS_SQL}, {SCHEDULE_SQL}, {VERDICTS_SQL}
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY ts_us DESC, request_id DESC) AS rn FROM verdicts) WHERE rn = 1""",
)
def latest_verdict_per_tab(t: Tables):
    return N.latest_per_tab(stream_verdicts(t))


@query(
    "latest_visit_per_tab",
    "tab_id:i request_id:i ts_us:i url:s",
    f"""WITH {VISITS_SQL} SELECT tab_id, request_id, ts_us, nullif(given, '') AS url FROM
    (SELECT *, row_number() OVER (PARTITION BY tab_id ORDER BY ts_us DESC, request_id DESC) AS rn FROM raw_visits) WHERE rn = 1""",
)
def latest_visit_per_tab(t: Tables):
    folder = run_folder(t, "tabs")
    visits = as_visits(t, event_stream(t))
    K.run_tabs(visits, folder).awaitTermination()
    return K.tabs_now(t.spark, folder, visits.schema)
