"""Cleaning and merging. Documents stand for URL rows: the text is the key, the row order is doc_id."""

from pyspark.sql import functions as F

from lurescan.operators import clean as B
from lurescan.plans.registry import Tables, query

# Rows keyed by text with the quality label where there is one.
ROWS_SQL = r"""
rows_of AS (
  SELECT d.doc_id AS row_idx, regexp_replace(regexp_replace(d.text, '^[\s\x0B\x{85}\p{Z}]+', ''), '[\s\x0B\x{85}\p{Z}]+$', '') AS url,
         d.lang, d.source, coalesce(l.quality, 0) AS label
  FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def labelled_rows(t: Tables):
    labels = t.labels.select("doc_id", "quality")
    return t.documents.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("row_idx"),
        F.col("text").alias("url"),
        "lang",
        "source",
        F.coalesce("quality", F.lit(0)).alias("label"),
    )


def page_labels(t: Tables):
    """URL table: label 1 for https."""
    return t.pages.select("url", F.col("url").startswith("https").cast("int").alias("label"))


def visited_labels(t: Tables):
    """Second URL table: pages on a site with a ``www`` or ``blog`` page, label by the md5."""
    url = F.col("url")
    return t.pages.filter(url.rlike("://(www|blog)[.]")).select(
        F.concat(F.lit(" "), url, F.lit(" ")).alias("url"),
        (F.substring(F.md5("url"), 1, 1) < "8").cast("int").alias("label"),
        F.length("html").alias("size"),
    )


TWO_SQL = r"""
a AS (SELECT url, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS label FROM pages),
b AS (SELECT url, CASE WHEN substr(md5(url), 1, 1) < '8' THEN 1 ELSE 0 END AS label, length(html) AS size
      FROM pages WHERE regexp_matches(url, '://(www|blog)[.]'))
"""


@query(
    "dedup_by_url",
    "row_idx:i text_key:s lang:s source:s label:i",
    f"""WITH {ROWS_SQL} SELECT row_idx, md5(url) AS text_key, lang, source, label FROM
    (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_idx) AS rn FROM rows_of) WHERE rn = 1""",
)
def dedup_by_url(t: Tables):
    return B.dedup_by_url(labelled_rows(t)).withColumn("text_key", F.md5("url"))


@query(
    "duplicate_report",
    "row_idx:i text_key:s label:i",
    f"""WITH {ROWS_SQL} SELECT row_idx, md5(url) AS text_key, label FROM
    (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_idx) AS rn FROM rows_of) WHERE rn > 1""",
)
def duplicate_report(t: Tables):
    return B.duplicate_report(labelled_rows(t)).withColumn("text_key", F.md5("url"))


@query(
    "value_counts",
    "value:s n:i share:d",
    """SELECT o_orderpriority AS value, count(*) AS n, count(*) / (SELECT count(*) FROM orders) AS share
    FROM orders GROUP BY o_orderpriority""",
)
def value_counts(t: Tables):
    return B.value_counts(t.orders, "o_orderpriority")


# Labels are missing for documents without a row in `labels`, prices where the order is pending.
GAPS_SQL = """
gaps AS (SELECT d.doc_id, d.lang, l.quality, CASE WHEN d.n_chars < 200 THEN CAST('NaN' AS DOUBLE) ELSE d.n_chars / 7 END AS ratio
         FROM documents d LEFT JOIN labels l USING (doc_id))
"""


def with_gaps(t: Tables):
    ratio = F.when(F.col("n_chars") < 200, F.lit(float("nan"))).otherwise(F.col("n_chars") / 7)
    return (
        t.documents.select("doc_id", "lang", ratio.alias("ratio"))
        .join(t.labels.select("doc_id", "quality"), "doc_id", "left")
        .select("doc_id", "lang", "quality", "ratio")
    )


@query(
    "missing_report",
    "column:s n_missing:i",
    f"""WITH {GAPS_SQL}
    SELECT 'doc_id' AS "column", sum(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) AS n_missing FROM gaps
    UNION ALL SELECT 'lang', sum(CASE WHEN lang IS NULL THEN 1 ELSE 0 END) FROM gaps
    UNION ALL SELECT 'quality', sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) FROM gaps
    UNION ALL SELECT 'ratio', sum(CASE WHEN ratio IS NULL OR isnan(ratio) THEN 1 ELSE 0 END) FROM gaps
    UNION ALL SELECT '(any)', sum(CASE WHEN quality IS NULL OR isnan(ratio) THEN 1 ELSE 0 END) FROM gaps""",
)
def missing_report(t: Tables):
    return B.missing_report(with_gaps(t))


@query(
    "drop_missing_rows",
    "doc_id:i lang:s quality:i ratio:d",
    f"WITH {GAPS_SQL} SELECT * FROM gaps WHERE quality IS NOT NULL AND NOT isnan(ratio)",
)
def drop_missing_rows(t: Tables):
    return B.drop_missing_rows(with_gaps(t))


@query(
    "drop_missing_cols",
    "doc_id:i lang:s n_columns:i",
    f"WITH {GAPS_SQL} SELECT doc_id, lang, 2 AS n_columns FROM gaps",
)
def drop_missing_cols(t: Tables):
    kept = B.drop_missing_cols(with_gaps(t))
    return kept.withColumn("n_columns", F.lit(len(kept.columns)))


@query(
    "missing_urls",
    "url:s label:i",
    f"WITH {TWO_SQL} SELECT url, label FROM a WHERE url NOT IN (SELECT url FROM b)",
)
def missing_urls(t: Tables):
    return B.missing_urls(page_labels(t), visited_labels(t))


@query(
    "merge_on_url",
    "url:s size:i label_first:i label_second:i",
    f"""WITH {TWO_SQL} SELECT a.url, b.size, a.label AS label_first, b.label AS label_second
    FROM a JOIN b ON a.url = b.url""",
)
def merge_on_url(t: Tables):
    return B.merge_on_url(page_labels(t), visited_labels(t))


@query(
    "label_mismatch_report",
    "url:s label_first:i label_second:i",
    f"""WITH {TWO_SQL} SELECT a.url, a.label AS label_first, b.label AS label_second
    FROM a JOIN b ON a.url = b.url WHERE a.label <> b.label""",
)
def label_mismatch_report(t: Tables):
    return B.label_mismatch_report(page_labels(t), visited_labels(t))


@query(
    "one_sided_report",
    "url:s label:i side:s",
    f"""WITH {TWO_SQL}, c AS (SELECT * FROM b UNION ALL SELECT text, item_id % 2, 0 FROM benchmark)
    SELECT url, label, 'first' AS side FROM a WHERE url NOT IN (SELECT url FROM c)
    UNION ALL SELECT url, label, 'second' FROM c WHERE url NOT IN (SELECT url FROM a)""",
)
def one_sided_report(t: Tables):
    extra = t.benchmark.select(
        F.col("text").alias("url"), (F.col("item_id") % 2).cast("int").alias("label")
    )
    second = visited_labels(t).select("url", "label").unionByName(extra)
    return B.one_sided_report(page_labels(t), second)


@query(
    "clean_pipeline",
    "row_idx:i label:i lang:s origin:s",
    f"""WITH {ROWS_SQL} SELECT row_idx, label, lang, 'crawl' AS origin FROM
    (SELECT *, row_number() OVER (PARTITION BY url ORDER BY row_idx) AS rn FROM rows_of) WHERE rn = 1""",
)
def clean_pipeline(t: Tables):
    return B.clean_pipeline(
        labelled_rows(t),
        [
            ("dedup_by_url",),
            ("drop_missing_rows",),
            ("drop_cols", ["source", "no_such_column"]),
            ("add_const_col", "origin", "crawl"),
            ("keep_cols", ["row_idx", "label", "lang", "origin", "unknown"]),
        ],
    )


# Order status as a label column of mixed text: numbers, text and gaps.
RAW_LABELS_SQL = """
raw_labels AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1' WHEN 'O' THEN '0.0'
                                  WHEN 'P' THEN CASE WHEN starts_with(o_orderpriority, '1') THEN NULL ELSE 'n/a' END END AS label FROM orders)
"""


def raw_labels(t: Tables):
    status = F.col("o_orderstatus")
    urgent = F.col("o_orderpriority").startswith("1")
    return t.orders.select(
        "o_orderkey",
        F.when(status == "F", "1")
        .when(status == "O", "0.0")
        .when((status == "P") & ~urgent, "n/a")
        .alias("label"),
    )


@query(
    "coerce_label",
    "o_orderkey:i label:i",
    f"""WITH {RAW_LABELS_SQL} SELECT o_orderkey, TRY_CAST(label AS DOUBLE) AS label FROM raw_labels
    WHERE TRY_CAST(label AS DOUBLE) IS NOT NULL""",
)
def coerce_label(t: Tables):
    return B.coerce_label(raw_labels(t))


@query(
    "missing_label_rows",
    "o_orderkey:i",
    f"WITH {RAW_LABELS_SQL} SELECT o_orderkey FROM raw_labels WHERE label IS NULL",
)
def missing_label_rows(t: Tables):
    return B.missing_label_rows(raw_labels(t))


@query(
    "describe_label",
    "count:i mean:d std:d min:d p25:d p50:d p75:d max:d",
    """SELECT count(label) AS count, avg(label) AS mean, stddev_samp(label) AS std, min(label) AS min,
      quantile_cont(label, 0.25) AS p25, quantile_cont(label, 0.5) AS p50, quantile_cont(label, 0.75) AS p75,
      max(label) AS max FROM embeddings""",
)
def describe_label(t: Tables):
    return B.describe_label(t.embeddings)


SPLIT_SQL = """
rows_of AS (SELECT l.quality AS label, d.lang AS split FROM labels l JOIN documents d USING (doc_id))
"""


def labels_by_lang(t: Tables):
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        F.col("quality").alias("label"), F.col("lang").alias("split")
    )


@query(
    "class_distribution",
    "split:s label:i n:i share:d",
    f"""WITH {SPLIT_SQL} SELECT split, label, count(*) AS n,
      count(*) / sum(count(*)) OVER (PARTITION BY split) AS share FROM rows_of GROUP BY split, label""",
)
def class_distribution(t: Tables):
    return B.class_distribution(labels_by_lang(t))


@query(
    "balance_report",
    "split:s total:i phishing:i benign:i phishing_pct:d benign_pct:d imbalance:d is_imbalanced:i",
    f"""WITH {SPLIT_SQL},
    c AS (SELECT split, count(*) AS total, sum(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS phishing,
                 sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS benign FROM rows_of GROUP BY split)
    SELECT *, 100.0 * phishing / total AS phishing_pct, 100.0 * benign / total AS benign_pct,
      CASE WHEN least(phishing, benign) = 0 THEN NULL ELSE greatest(phishing, benign)::DOUBLE / least(phishing, benign) END AS imbalance,
      CASE WHEN least(phishing, benign) = 0 OR greatest(phishing, benign)::DOUBLE / least(phishing, benign) > 1.5 THEN 1 ELSE 0 END AS is_imbalanced
    FROM c""",
)
def balance_report(t: Tables):
    return B.balance_report(labels_by_lang(t))


@query(
    "label_text",
    "label:i label_text:s n:i",
    """SELECT label, CASE label WHEN 0 THEN 'phishing' WHEN 1 THEN 'benign' END AS label_text, count(*) AS n
    FROM embeddings GROUP BY label""",
)
def label_text(t: Tables):
    return (
        t.embeddings.groupBy("label")
        .agg(F.count("*").alias("n"))
        .withColumn("label_text", B.label_text(F.col("label")))
    )
