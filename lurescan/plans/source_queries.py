"""Round trips through files, crawl output and resumable builds."""

import uuid

from pyspark.sql import functions as F

from lurescan import schemas
from lurescan.operators import attributions as L
from lurescan.operators import dataset as G
from lurescan.operators import evaluate as K
from lurescan.operators.tables import cut_lineage, shared_folder
from lurescan.operators.url_features import brand_names
from lurescan.plans import evaluation_queries, url_queries
from lurescan.plans.registry import Tables, query
from lurescan.plans.url_queries import PARTS_SQL
from lurescan.sources import crawl, files, resumable


def new_folder(t: Tables, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def snapshots(t: Tables):
    """Addresses and brand names, found once for all the writes of a build."""
    return cut_lineage(url_queries.dns_snapshot(t)), brand_names(url_queries.www_brands(t))


def url_list(t: Tables):
    return t.pages.select("url", F.col("url").startswith("https").cast("int").alias("label"))


@query(
    "url_list_round_trip",
    "url:s label:i",
    "SELECT url, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS label FROM pages",
)
def url_list_round_trip(t: Tables):
    folder = new_folder(t, "url-list")
    files.write_table(url_list(t), folder, sep=";")
    return files.read_url_list(t.spark, folder)


@query(
    "quoted_url_list",
    "url:s label:i",
    "SELECT nullif(text, '') AS url, CAST(doc_id % 2 AS INTEGER) AS label FROM documents",
)
def quoted_url_list(t: Tables):
    """A list whose fields hold line breaks, quotes and separators: the texts in place of the URLs."""
    folder = new_folder(t, "quoted")
    texts = t.documents.select(F.col("text").alias("url"), (F.col("doc_id") % 2).cast("int").alias("label"))
    kept = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    texts.write.options(**kept).csv(folder, sep=";", header=True, quote='"', escape='"')
    return files.read_url_list(t.spark, folder)


@query(
    "tolerant_read",
    "url:s label:i",
    "SELECT url, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS label FROM pages",
)
def tolerant_read(t: Tables):
    """The URL list with the benchmark texts as lines that do not fit."""
    return files.read_tolerant(t.spark, uneven_lines(t), schemas.URL_LIST)


def uneven_lines(t: Tables) -> str:
    folder = new_folder(t, "tolerant")
    good = url_list(t).select(F.concat_ws(";", "url", F.col("label").cast("string")).alias("url;label"))
    bad = t.benchmark.select(F.concat(F.lit("x;"), F.regexp_replace("text", r"[\s;\"]+", " ")).alias("url;label"))
    lines = good.unionByName(bad)
    lines.write.csv(folder, header=True, sep="\t", escapeQuotes=False)
    return folder


@query(
    "audited_read",
    "url:s label:i fits:i",
    """SELECT url, CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS label, 1 AS fits FROM pages
    UNION ALL SELECT 'x', NULL, 0 FROM benchmark""",
)
def audited_read(t: Tables):
    rows = files.read_with_audit(t.spark, uneven_lines(t), schemas.URL_LIST)
    return rows.withColumn("fits", F.col(files.CORRUPT).isNull().cast("int"))


@query(
    "brand_list",
    "brand:s",
    f"WITH {PARTS_SQL}, {url_queries.BRANDS_SQL} SELECT brand FROM brands",
)
def brand_list(t: Tables):
    """The brands written with blanks, empty lines and repeats, and read back."""
    folder = new_folder(t, "brands")
    names = url_queries.www_brands(t)
    padded = names.select(F.concat(F.lit("  "), "brand", F.lit(" ")).alias("line"))
    names.unionByName(padded.withColumnRenamed("line", "brand")).unionByName(
        names.select(F.lit("  ").alias("brand"))).write.text(folder)
    return files.read_brands(t.spark, folder)


@query(
    "merged_parts",
    "url:s label:s size:s source:s",
    """SELECT url, CASE WHEN starts_with(url, 'https') THEN '1' ELSE '0' END AS label, NULL AS size, NULL AS source FROM pages
    UNION ALL SELECT url, NULL, CAST(length(html) AS VARCHAR), 'crawl' FROM pages""",
)
def merged_parts(t: Tables):
    folder = new_folder(t, "parts")
    files.write_table(url_list(t), f"{folder}/first", sep=";", bom=True)
    sized = t.pages.select("url", F.length("html").alias("size"), F.lit("crawl").alias("source"))
    files.write_table(sized, f"{folder}/second", sep=";")
    return files.read_parts(t.spark, f"{folder}/*")


@query(
    "crawl_records",
    "requested_url:s url:s is_alive:i is_empty_title:i nb_divs:i content_txt_len:i has_onclick:i punctuation_density:d error_reason:s",
    """WITH c AS (SELECT url, substr(md5(url), 1, 1) AS kind, length(html) AS n FROM pages)
    SELECT url AS requested_url, CASE WHEN kind IN ('0', '1', '2') THEN url ELSE url || '#crawled' END AS url,
      CASE WHEN kind IN ('0', '1', '2') THEN 0 ELSE 1 END AS is_alive, CASE WHEN kind IN ('0', '1', '2') THEN 1 ELSE 0 END AS is_empty_title,
      CASE WHEN kind IN ('0', '1', '2') THEN 0 ELSE n % 7 END AS nb_divs, CASE WHEN kind IN ('0', '1', '2') THEN 0 ELSE n END AS content_txt_len,
      CASE WHEN kind IN ('0', '1', '2') THEN 0 ELSE n % 3 END AS has_onclick,
      CASE WHEN kind IN ('0', '1', '2') THEN 0 WHEN kind = '3' THEN NULL ELSE 1 / n END AS punctuation_density,
      CASE WHEN kind = '2' THEN 'Page not accessible or redirected to error page' END AS error_reason FROM c""",
)
def crawl_records(t: Tables):
    """Crawler output with broken JSON, failed runs, dead pages and a missing number."""
    kind, n = F.substring(F.md5("url"), 1, 1), F.length("html")
    alive = F.to_json(
        F.struct(
            F.lit(1).alias("is_alive"), F.concat("url", F.lit("#crawled")).alias("url"),
            F.lit(0).alias("is_empty_title"), (n % 7).alias("nb_divs"), n.alias("inner_text_len"),
            (n % 3).alias("elements_with_onclick"), F.when(kind != "3", 1 / n).alias("punctuation_density"),
            F.struct(F.lit(1920).alias("width"), F.lit(1080).alias("height")).alias("viewport"),
        )
    )
    dead = F.lit('{"is_alive":0,"error_reason":"Page not accessible or redirected to error page"}')
    records = t.pages.select(
        "url",
        F.when(kind == "0", "Debug page\n{").when(kind == "2", dead).otherwise(alive).alias("stdout"),
        F.when(kind == "1", 1).otherwise(0).alias("exit_code"),
    )
    return crawl.parse_crawl_output(records)


@query(
    "resumable_build",
    "row_idx:i url:s url_len:i nb_slash:i chunk_id:i reason:s label:i",
    f"""WITH {PARTS_SQL}
    SELECT page_id AS row_idx, url, length(url) AS url_len, len(string_split(url, '/')) - 1 AS nb_slash, page_id // 40 AS chunk_id,
      NULL AS reason, CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS label FROM urls""",
)
def resumable_build(t: Tables):
    """Static dataset built in two goes: first the http pages' chunks, then what is missing."""
    folder = new_folder(t, "resumable")
    rows = t.pages.select(F.col("page_id").alias("row_idx"), "url", F.col("url").startswith("https").cast("int").alias("label"))
    dns, brands = snapshots(t)

    def build(part):
        return G.build_static_dataset(part, brands, dns, url_queries.SUFFIX_RULES)

    half = rows.agg(F.floor(F.max("row_idx") / 80).cast("int") * 40).first()[0]
    resumable.build_resumable(rows.filter(F.col("row_idx") < half), build, folder, step=40)
    resumable.build_resumable(rows, build, folder, step=40)
    return t.spark.read.parquet(folder)


@query(
    "resumable_stream_build",
    "row_idx:i url:s url_len:i nb_slash:i chunk_id:i reason:s label:i",
    f"""WITH {PARTS_SQL}
    SELECT page_id AS row_idx, url, length(url) AS url_len, len(string_split(url, '/')) - 1 AS nb_slash, page_id // 40 AS chunk_id,
      NULL AS reason, CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS label FROM urls""",
)
def resumable_stream_build(t: Tables):
    """The static dataset as a stream over chunks; a second query goes on from the checkpoint of the first."""
    folder = new_folder(t, "stream-build")
    rows = t.pages.select(F.col("page_id").alias("row_idx"), "url", F.col("url").startswith("https").cast("int").alias("label"))
    dns, brands = snapshots(t)

    def build(part):
        return G.build_static_dataset(part, brands, dns, url_queries.SUFFIX_RULES)

    last = rows.agg(F.floor(F.max("row_idx") / 40)).first()[0]
    per_batch = last // 4 + 1
    for part in (rows.filter(F.col("row_idx") < (last // 2) * 40), rows):
        resumable.stage_chunks(part, folder, step=40)
        resumable.run_build(t.spark, rows.schema, folder, build, per_batch).awaitTermination()
    return resumable.built(t.spark, folder)


@query(
    "prepared_sets",
    "set_name:s label:i n:i",
    """SELECT CASE WHEN substr(md5(url), 1, 1) < '4' THEN 'test' ELSE 'train' END AS set_name,
      CASE WHEN starts_with(url, 'https') THEN 1 ELSE 0 END AS label, count(*) AS n FROM pages GROUP BY 1, 2""",
)
def prepared_sets(t: Tables):
    folder = new_folder(t, "sets")
    test = F.substring(F.md5("url"), 1, 1) < "4"
    files.save_sets(
        {"train": url_list(t).filter(~test), "test": url_list(t).filter(test)}, folder
    )
    sets = files.load_sets(t.spark, folder, ["train", "test"])
    both = sets["train"].withColumn("set_name", F.lit("train")).unionByName(
        sets["test"].withColumn("set_name", F.lit("test"))
    )
    return both.groupBy("set_name", "label").agg(F.count("*").alias("n"))


@query(
    "resumable_attributions",
    "chunk_id:i samples:i tokens:i",
    """SELECT doc_id // 500 AS chunk_id, count(*) AS samples, sum(len(string_split(text, ' '))) AS tokens
    FROM documents GROUP BY 1""",
)
def resumable_attributions(t: Tables):
    """Attribution intake by chunks of 500 samples; a second call finds nothing to do."""
    folder = new_folder(t, "attributions")
    samples = t.documents.select(F.col("doc_id").alias("sample_id"), "text")

    def build(part):
        words = part.select("sample_id", "chunk_id", F.posexplode(F.split("text", " ")).alias("pos", "token"))
        return words.withColumns({"class_idx": F.lit(1), "value": F.length("token") / 100})

    for _ in range(2):
        resumable.build_resumable(samples, build, folder, index="sample_id", step=500, rowwise=True)
    stored = L.of_class(t.spark.read.parquet(folder))
    per_sample = stored.groupBy("chunk_id", "sample_id").agg(F.count("*").alias("n"))
    return per_sample.groupBy("chunk_id").agg(
        F.count("*").alias("samples"), F.sum("n").alias("tokens")
    )


@query(
    "stored_results",
    "label:i pred:i n:i",
    f"""WITH {evaluation_queries.SCORES_SQL} SELECT 0 AS label, 0 AS pred, tn AS n FROM tally UNION ALL SELECT 0, 1, fp FROM tally
    UNION ALL SELECT 1, 0, fn FROM tally UNION ALL SELECT 1, 1, tp FROM tally""",
)
def stored_results(t: Tables):
    """The confusion matrix written as JSON and CSV and read back."""
    folder = new_folder(t, "results")
    matrix = {"confusion": K.confusion_matrix(evaluation_queries.scores(t))}
    files.write_results(matrix, f"{folder}/json", "json")
    files.write_results(matrix, f"{folder}/csv")
    from_json = t.spark.read.schema("label int, pred int, n long").json(f"{folder}/json/confusion")
    from_csv = t.spark.read.csv(f"{folder}/csv/confusion", schema="label int, pred int, n long", header=True)
    return from_json.join(from_csv, ["label", "pred", "n"])
