"""Page content features over ``pages.html`` and text measures over ``documents.text``."""

from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.functions import text as T
from lurescan.operators import page_features as P
from lurescan.operators.tables import spread
from lurescan.plans.registry import Tables, query

AS_OF_YEAR = 2024

WIDE = r"\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
SPACES = rf"[ \t\n\x0B\f\r{WIDE}]"
TOKENS = (
    r"(?is)<!--.*?-->|<![^>]*>|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>"
    r"|<title[^>]*>.*?</title>|</[^>]*>|<[a-z][^>]*>|[^<]+|<"
)


def decode_sql(expr: str) -> str:
    for name, char in [
        ("lt", "<"), ("gt", ">"), ("quot", '"'), ("nbsp", "\u00a0"), ("copy", "\u00a9"),
        ("middot", "\u00b7"), ("amp", "&"),
    ]:
        expr = f"replace({expr}, '&{name};', '{char}')"
    return expr


NODES_SQL = rf"""
tokenised AS (SELECT page_id, url, html, regexp_extract_all(html, '{TOKENS}') AS toks FROM pages),
nodes AS (
  SELECT page_id, tok, pos, lower(regexp_extract(tok, '^<([a-zA-Z][^\s/>]*)', 1)) AS tag
  FROM (SELECT page_id, unnest(toks) AS tok, unnest(range(1, len(toks) + 1)) AS pos FROM tokenised)),
raw_nodes AS (
  SELECT *, regexp_replace(regexp_replace(tok, '^<[^>]*>', ''), '(?i)</[a-z]+>$', '') AS inner_text FROM nodes),
bodies AS (SELECT page_id, min(pos) AS body_at FROM nodes WHERE tag = 'body' GROUP BY page_id),
texts AS (
  SELECT n.page_id,
    coalesce(string_agg(CASE WHEN n.pos <= b.body_at THEN '' WHEN NOT starts_with(tok, '<') OR tok = '<' THEN {decode_sql("tok")}
                             WHEN tag IN ('script', 'style') THEN inner_text WHEN tag = 'title' THEN {decode_sql("inner_text")}
                             ELSE '' END, '' ORDER BY n.pos), '') AS body_text,
    coalesce(string_agg(CASE WHEN tag = 'script' THEN inner_text END, '' ORDER BY n.pos), '') AS script_text,
    coalesce(string_agg(CASE WHEN tag = 'style' THEN inner_text END, '' ORDER BY n.pos), '') AS style_text,
    coalesce(min(CASE WHEN tag = 'title' THEN trim(regexp_replace({decode_sql("inner_text")}, '{SPACES}+', ' ', 'g')) END), '') AS title,
    sum(CASE WHEN tag <> '' THEN 1 ELSE 0 END) AS total_elements
  FROM raw_nodes n JOIN bodies b USING (page_id) GROUP BY n.page_id)
"""


def measures_sql(table: str, key: str, text: str) -> str:
    """Sentences, words, syllables and readability of a text column."""
    return rf"""
squeezed AS (SELECT {key}, trim(regexp_replace({text}, '{SPACES}+', ' ', 'g')) AS clean FROM {table}),
sents AS (SELECT {key}, clean, list_filter(string_split_regex(clean, '[.!?]+ |[.!?]+$'),
            lambda s: length(trim(s)) >= 3 AND regexp_matches(s, '[a-zA-Z]')) AS kept FROM squeezed),
words_of AS (SELECT {key}, unnest(string_split(clean, ' ')) AS w FROM squeezed),
parts_of AS (
  SELECT {key}, letters, length(letters) AS n, len(regexp_extract_all(letters, '[aeiouy]+')) AS g,
         CASE WHEN letters LIKE '%e' THEN 1 ELSE 0 END AS e,
         CASE WHEN regexp_matches(letters, '[^aeiouy]le$') THEN 1 ELSE 0 END AS le
  FROM (SELECT {key}, regexp_replace(lower(w), '[^a-z]', '', 'g') AS letters FROM words_of
        WHERE regexp_matches(w, '[a-zA-Z0-9]'))),
counts AS (
  SELECT {key}, count(*) AS n_words,
         sum(CASE WHEN n = 0 THEN 0 WHEN n <= 3 THEN 1
                  ELSE greatest(1, g - CASE WHEN e = 1 AND g > 1 THEN 1 ELSE 0 END + le) END) AS n_syllables
  FROM parts_of GROUP BY {key}),
measures AS (
  SELECT s.{key}, len(s.kept) AS n_sentences, coalesce(c.n_words, 0) AS n_words,
         coalesce(c.n_syllables, 0) AS n_syllables,
         CASE WHEN len(s.kept) = 0 THEN 0 ELSE
           list_sum(list_transform(s.kept, lambda x: len(list_filter(string_split(trim(x), ' '),
             lambda w: regexp_matches(w, '[a-zA-Z0-9]'))))) / len(s.kept) END AS avg_sentence_len,
         CASE WHEN len(s.kept) = 0 OR coalesce(c.n_words, 0) = 0 THEN 0 ELSE
           floor((206.835 - 1.015::DOUBLE * (c.n_words / len(s.kept)) - 84.6::DOUBLE * (c.n_syllables / c.n_words)) * 100 + 0.5) / 100 END AS readability_score
  FROM sents s LEFT JOIN counts c USING ({key}))
"""


@query(
    "page_elements",
    "page_id:i pos:i tag:s class:s href:s",
    rf"""WITH {NODES_SQL}
    SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, tag,
      nullif(regexp_extract(tok, '^<[^>]*\sclass="([^"]*)"', 1), '') AS class,
      nullif(regexp_extract(tok, '^<[^>]*\shref="([^"]*)"', 1), '') AS href
    FROM nodes WHERE tag <> ''""",
)
def page_elements(t: Tables):
    return P.page_elements(spread(t.pages)).withColumns(
        {
            "class": F.try_element_at("attrs", F.lit("class")),
            "href": F.try_element_at("attrs", F.lit("href")),
        }
    )


@query(
    "page_text",
    "page_id:i title:s text_key:s script_text:s style_text:s html_len:i",
    f"""WITH {NODES_SQL}
    SELECT page_id, title, md5(body_text) AS text_key, script_text, style_text, length(html) AS html_len
    FROM texts JOIN pages USING (page_id)""",
)
def page_text(t: Tables):
    return P.page_text(spread(t.pages)).withColumn("text_key", F.md5("body_text"))


@query(
    "page_tag_counts",
    "page_id:i total_elements:i " + " ".join(f"{c}:i" for c in C.TAG_COUNTS),
    f"WITH {NODES_SQL} SELECT page_id, count(*) AS total_elements, "
    + ", ".join(
        f"sum(CASE WHEN tag IN ({', '.join(repr(x) for x in tags)}) THEN 1 ELSE 0 END) AS {c}"
        for c, tags in C.TAG_COUNTS.items()
    )
    + " FROM nodes WHERE tag <> '' GROUP BY page_id",
)
def page_tag_counts(t: Tables):
    return P.page_features_raw(t.pages, AS_OF_YEAR)


def _says(*phrases: str) -> str:
    return "(" + " OR ".join(f"contains(lower(body_text), '{p}')" for p in phrases) + ")"


@query(
    "page_text_measures",
    "page_id:i content_txt_len:i body_len:i script_len:i is_empty_title:i nb_special_char:i has_popup:i "
    "has_right_click:i has_ssl:i has_popup_ad:i has_ad_keywords:i has_copyright_year:i avg_sentence_len:d "
    "avg_words_per_sentence:d readability_score:d txt_to_html_ratio:d txt_to_tag_ratio:d link_density:d "
    "img_density:d unique_words_ratio:d punctuation_density:d num_in_txt:i avg_paragraph_len:d",
    rf"""WITH {NODES_SQL}, {measures_sql("texts", "page_id", "body_text")},
    tags AS (SELECT page_id, sum(CASE WHEN tag = 'a' THEN 1 ELSE 0 END) AS n_a,
                    sum(CASE WHEN tag = 'img' THEN 1 ELSE 0 END) AS n_img,
                    sum(CASE WHEN tag = 'p' THEN 1 ELSE 0 END) AS n_p FROM nodes GROUP BY page_id)
    SELECT page_id, length(body_text) AS content_txt_len, length(body_text) AS body_len, length(script_text) AS script_len,
      CASE WHEN title = '' THEN 1 ELSE 0 END AS is_empty_title,
      length(regexp_replace(body_text, '[a-zA-Z0-9 \t\n\x0B\f\r{WIDE}]', '', 'g')) AS nb_special_char,
      CASE WHEN {_says("prompt(", "alert(", "confirm(")} THEN 1 ELSE 0 END AS has_popup,
      CASE WHEN {_says("contextmenu", "event.button")} THEN 1 ELSE 0 END AS has_right_click,
      CASE WHEN {_says("secure", "ssl", "encrypted")} THEN 1 ELSE 0 END AS has_ssl,
      CASE WHEN {_says("popup", "pop-up")} THEN 1 ELSE 0 END AS has_popup_ad,
      len(regexp_extract_all(lower(body_text), '(advertisement|sponsored|ad|banner)')) AS has_ad_keywords,
      CASE WHEN contains(body_text, '{AS_OF_YEAR}') THEN 1 ELSE 0 END AS has_copyright_year,
      avg_sentence_len, avg_sentence_len AS avg_words_per_sentence, readability_score,
      length(body_text) / length(html) AS txt_to_html_ratio, length(body_text) / total_elements AS txt_to_tag_ratio,
      n_a / len(string_split(body_text, ' ')) AS link_density, n_img / len(string_split(body_text, ' ')) AS img_density,
      len(list_distinct(string_split_regex(lower(body_text), '{SPACES}+'))) / len(string_split_regex(body_text, '{SPACES}+')) AS unique_words_ratio,
      length(regexp_replace(body_text, '[^.,;:!?]', '', 'g')) / length(body_text) AS punctuation_density,
      len(regexp_extract_all(body_text, '[0-9]+')) AS num_in_txt,
      CASE WHEN n_p = 0 THEN 0 ELSE length(body_text) / n_p END AS avg_paragraph_len
    FROM texts JOIN pages USING (page_id) JOIN tags USING (page_id) JOIN measures USING (page_id)""",
)
def page_text_measures(t: Tables):
    return P.page_features_raw(t.pages, AS_OF_YEAR)


_HOST = "lower(regexp_extract(p.url, '^[a-z]+://([^/?#:]*)', 1))"


def _class(*pieces: str) -> str:
    return "(" + " OR ".join(f"contains(class, '{x}')" for x in pieces) + ")"


def _id(*pieces: str) -> str:
    return "(" + " OR ".join(f"contains(id, '{x}')" for x in pieces) + ")"


def _sum(test: str, name: str) -> str:
    return f"sum(CASE WHEN {test} THEN 1 ELSE 0 END) AS {name}"


def _max(test: str, name: str) -> str:
    return f"max(CASE WHEN {test} THEN 1 ELSE 0 END) AS {name}"


@query(
    "page_element_flags",
    "page_id:i has_onclick:i has_onmouse:i has_onload:i nb_ext_links:i nb_ext_scripts:i nb_ext_imgs:i "
    "nb_input_types:i form_complexity:d has_password_field:i has_login_form:i has_file_upload:i has_captcha:i "
    "has_date_stamps:i has_new_badges:i nb_social_media_links:i has_social_sharing:i nb_social_buttons:i "
    "has_sus_ad_class:i has_comment_sections:i has_rating_system:i has_search_box:i has_view_port_meta:i "
    "has_responsive_imgs:i has_mobile_css:i",
    rf"""WITH {NODES_SQL},
    attrs AS (SELECT n.page_id, n.tag, n.tok, n.inner_text, {_HOST} AS host,
        regexp_extract(n.tok, '^<[^>]*\sclass="([^"]*)"', 1) AS class, regexp_extract(n.tok, '^<[^>]*\sid="([^"]*)"', 1) AS id,
        regexp_extract(n.tok, '^<[^>]*\shref="([^"]*)"', 1) AS href, regexp_extract(n.tok, '^<[^>]*\ssrc="([^"]*)"', 1) AS src,
        regexp_extract(n.tok, '^<[^>]*\stype="([^"]*)"', 1) AS kind, regexp_extract(n.tok, '^<[^>]*\sname="([^"]*)"', 1) AS name
      FROM raw_nodes n JOIN pages p USING (page_id) WHERE n.tag <> '')
    SELECT page_id,
      {_sum("regexp_matches(tok, '^<[^>]*[[:space:]]onclick=')", "has_onclick")},
      {_sum("regexp_matches(tok, '^<[^>]*[[:space:]]onmouse(over|out|down|up)=')", "has_onmouse")},
      {_sum("regexp_matches(tok, '^<[^>]*[[:space:]]onload=')", "has_onload")},
      {_sum("tag = 'a' AND starts_with(href, 'http') AND NOT contains(lower(href), host)", "nb_ext_links")},
      {_sum("tag = 'script' AND starts_with(src, 'http') AND NOT contains(lower(src), host)", "nb_ext_scripts")},
      {_sum("tag = 'img' AND starts_with(src, 'http') AND NOT contains(lower(src), host)", "nb_ext_imgs")},
      count(DISTINCT CASE WHEN tag = 'input' THEN CASE WHEN kind = '' THEN 'text' ELSE lower(kind) END END) AS nb_input_types,
      sum(CASE WHEN tag IN ('input', 'select', 'textarea') THEN 1 ELSE 0 END) / greatest(sum(CASE WHEN tag = 'form' THEN 1 ELSE 0 END), 1) AS form_complexity,
      {_max("tag = 'input' AND lower(kind) = 'password'", "has_password_field")},
      {_max("tag = 'input' AND lower(kind) = 'password'", "has_login_form")},
      {_max("tag = 'input' AND lower(kind) = 'file'", "has_file_upload")},
      greatest({_max(_class("captcha") + " OR " + _id("captcha"), "x").replace(" AS x", "")},
               max(CASE WHEN contains(lower(b.body_text), 'captcha') THEN 1 ELSE 0 END)) AS has_captcha,
      {_sum("tag = 'time' OR regexp_matches(tok, '^<[^>]*[[:space:]]datetime')", "has_date_stamps")},
      {_sum(_class("new", "badge"), "has_new_badges")},
      {_sum("tag = 'a' AND regexp_matches(lower(href), '" + "|".join(C.SOCIAL_SITES) + "')", "nb_social_media_links")},
      {_max(_class("share", "social"), "has_social_sharing")},
      {_sum(_class("facebook", "twitter", "share"), "nb_social_buttons")},
      {_sum(_class("ad", "banner") + " OR " + _id("ad"), "has_sus_ad_class")},
      {_max(_class("comment") + " OR " + _id("comment"), "has_comment_sections")},
      {_max(_class("rating", "star", "review"), "has_rating_system")},
      {_max("(tag = 'input' AND lower(kind) = 'search') OR " + _class("search"), "has_search_box")},
      {_max("tag = 'meta' AND name = 'viewport'", "has_view_port_meta")},
      {_sum("tag = 'picture' OR (tag = 'img' AND contains(tok, 'srcset'))", "has_responsive_imgs")},
      {_max("(tag = 'style' AND contains(inner_text, '@media')) OR (tag = 'link' AND contains(tok, 'stylesheet') AND contains(href, 'mobile'))", "has_mobile_css")}
    FROM attrs JOIN texts b USING (page_id) GROUP BY page_id""",
)
def page_element_flags(t: Tables):
    return P.page_features_raw(t.pages, AS_OF_YEAR)


@query(
    "page_validity",
    "page_id:i has_error_indicators:i content_length:i is_minimal_content:i has_generic_structure:i is_alive:i error_reason:s",
    rf"""WITH {NODES_SQL},
    tags AS (SELECT page_id, sum(CASE WHEN tag = 'div' THEN 1 ELSE 0 END) AS n_div,
                    sum(CASE WHEN tag = 'p' THEN 1 ELSE 0 END) AS n_p FROM nodes GROUP BY page_id),
    checked AS (
      SELECT page_id, n_div, n_p,
        length(regexp_replace(regexp_replace(body_text, '^{SPACES}+', ''), '{SPACES}+$', '')) AS content_length,
        CASE WHEN {" OR ".join(f"contains(lower(body_text), '{p}') OR contains(lower(title), '{p}')" for p in C.ERROR_PHRASES)} THEN 1 ELSE 0 END AS bad
      FROM texts JOIN tags USING (page_id))
    SELECT page_id, bad AS has_error_indicators, content_length,
      CASE WHEN content_length < 50 THEN 1 ELSE 0 END AS is_minimal_content,
      CASE WHEN n_div < 3 AND n_p < 1 THEN 1 ELSE 0 END AS has_generic_structure,
      1 - bad AS is_alive,
      CASE WHEN bad = 1 THEN 'Page appears to be an error/placeholder page' END AS error_reason
    FROM checked""",
)
def page_validity(t: Tables):
    return P.page_features_raw(t.pages, AS_OF_YEAR)


@query(
    "page_status",
    "page_id:i is_alive:i error_reason:s nb_divs:i is_empty_title:i",
    rf"""WITH {NODES_SQL},
    tags AS (SELECT page_id, sum(CASE WHEN tag = 'div' THEN 1 ELSE 0 END) AS n_div FROM nodes GROUP BY page_id),
    checked AS (
      SELECT page_id, n_div, title, substr(md5(CAST(page_id AS VARCHAR)), 1, 1) < '4' AS refused,
        {" OR ".join(f"contains(lower(body_text), '{p}') OR contains(lower(title), '{p}')" for p in C.ERROR_PHRASES)} AS bad
      FROM texts JOIN tags USING (page_id))
    SELECT page_id, CASE WHEN refused OR bad THEN 0 ELSE 1 END AS is_alive,
      CASE WHEN refused THEN 'Page not accessible or redirected to error page' WHEN bad THEN 'Page appears to be an error/placeholder page' END AS error_reason,
      CASE WHEN refused OR bad THEN 0 ELSE n_div END AS nb_divs,
      CASE WHEN refused OR bad OR title = '' THEN 1 ELSE 0 END AS is_empty_title FROM checked""",
)
def page_status(t: Tables):
    """A quarter of the pages was answered with an HTTP status of 404 or 503."""
    kind = F.substring(F.md5(F.col("page_id").cast("string")), 1, 1)
    status = F.when(kind < "2", 404).when(kind < "4", 503).otherwise(200)
    return P.page_features(t.pages.withColumn("status_code", status), AS_OF_YEAR)


@query(
    "document_readability",
    "doc_id:i n_sentences:i n_words:i n_syllables:i avg_sentence_len:d readability_score:d",
    f"""WITH {measures_sql("documents", "doc_id", "text")} SELECT * FROM measures""",
)
def document_readability(t: Tables):
    docs = spread(t.documents.select("doc_id", "text"))
    clean = docs.withColumn("clean", T.squeeze(T.plain_spaces(F.col("text"))))
    return T.with_readability(
        clean.withColumn("kept", T.sentences(F.col("clean"))), "clean", "kept"
    )


@query(
    "word_syllables",
    "word:s n:i syllables:i",
    rf"""WITH words AS (SELECT unnest(string_split_regex(lower(text), '{SPACES}+')) AS word FROM documents),
    counted AS (SELECT word, count(*) AS n, regexp_replace(word, '[^a-z]', '', 'g') AS letters FROM words WHERE word <> '' GROUP BY word),
    grouped AS (SELECT *, len(regexp_extract_all(letters, '[aeiouy]+')) AS g FROM counted)
    SELECT word, n, CASE WHEN letters = '' THEN 0 WHEN length(letters) <= 3 THEN 1 ELSE
       greatest(1, g - CASE WHEN letters LIKE '%e' AND g > 1 THEN 1 ELSE 0 END
                 + CASE WHEN regexp_matches(letters, '[^aeiouy]le$') THEN 1 ELSE 0 END) END AS syllables
    FROM grouped""",
)
def word_syllables(t: Tables):
    pieces = F.split(F.lower(T.plain_spaces(F.col("text"))), r"\s+")
    return (
        spread(t.documents.select("text"))
        .select(F.explode(pieces).alias("word"))
        .filter("word != ''")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
        .withColumn("syllables", T.syllables_of_word(F.col("word")))
    )
