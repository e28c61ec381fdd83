"""Page content features of a snapshot ``pages(page_id, url, html[, status_code])``.

One page is one row and every feature is computed in the projection of that row, so the job has no
shuffle and a host with many pages does not skew it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.functions import html as H
from lurescan.functions import text as T
from lurescan.functions import url as U
from lurescan.operators.tables import spread


def with_page_tokens(pages: DataFrame) -> DataFrame:
    """Add tokens, nodes (tag and token), tag names, body, title, script and style text."""
    nodes = F.col("_nodes")
    body_at = F.array_position(nodes["tag"], "body")
    head_end = F.array_position(F.transform("tokens", F.lower), "</head>")
    start = F.when(body_at > 0, body_at).otherwise(head_end)

    def contents(name: str) -> Column:
        hits = F.filter(nodes, lambda n: n["tag"] == name)
        return F.transform(hits, lambda n: H.raw_content(n["token"]))

    return (
        pages.withColumn("tokens", H.tokens(F.col("html")))
        .withColumn("_nodes", H.nodes(F.col("tokens")))
        .withColumns(
            {
                "tags": F.array_remove(nodes["tag"], ""),
                "title": F.coalesce(
                    U.let(
                        U.let(F.get(contents("title"), F.lit(0)), H.decode_entities),
                        lambda text: T.squeeze(T.plain_spaces(text)),
                    ),
                    F.lit(""),
                ),
                "body_text": H.text_content(
                    F.slice(nodes, (start + 1).cast("int"), F.size("tokens"))
                ),
                "script_text": F.array_join(contents("script"), ""),
                "style_text": F.array_join(contents("style"), ""),
                "html_len": F.length("html"),
            }
        )
    )


def page_elements(pages: DataFrame) -> DataFrame:
    """One row per start tag: page_id, pos, tag, attrs (map)."""
    element = F.posexplode(H.elements(H.nodes(H.tokens(F.col("html"))))).alias("pos", "element")
    first_of_each = F.filter(
        "element.attrs",
        lambda a, i: ~F.exists(
            F.slice("element.attrs", F.lit(1), i), lambda b: b["name"] == a["name"]
        ),
    )
    return pages.select("page_id", element).select(
        "page_id", "pos", "element.tag", F.map_from_entries(first_of_each).alias("attrs")
    )


def page_text(pages: DataFrame) -> DataFrame:
    return with_page_tokens(pages).select(
        "page_id", "title", "body_text", "script_text", "style_text", "html_len"
    )


def _tag_counts() -> dict[str, Column]:
    """Occurrences in ``|html||body||p|``: a byte search per tag instead of a lambda."""
    return {
        column: U.occurrences("_tag_text", *[f"|{n}|" for n in names])
        for column, names in C.TAG_COUNTS.items()
    } | {"total_elements": F.size("tags")}


def ad_keywords(lower: str) -> Column:
    """Keyword occurrences. No keyword overlaps another except the one that begins with ``ad``,
    which is counted once through it, so the counts of the rest add up."""
    return U.occurrences(lower, *[k for k in C.AD_KEYWORDS if k != "advertisement"])


def _text_columns() -> dict[str, Column]:
    body = F.col("body_text")
    length = F.length(body)

    def says(*phrases: str) -> Column:
        return U.flag(U.contains_any("_lower", phrases))

    return {
        "content_txt_len": length,
        "body_len": length,
        "script_len": F.length("script_text"),
        "is_empty_title": U.flag(F.col("title") == ""),
        "nb_special_char": T.special_characters(F.col("_plain")),
        "has_popup": says("prompt(", "alert(", "confirm("),
        "has_right_click": says("contextmenu", "event.button", "oncontextmenu"),
        "has_ssl": says("secure", "ssl", "encrypted"),
        "has_popup_ad": says("popup", "pop-up"),
        "has_ad_keywords": ad_keywords("_lower"),
        "unique_words_ratio": F.when(length > 0, T.unique_words_ratio(F.col("_pieces"))).otherwise(F.lit(0.0)),
        "punctuation_density": F.try_divide(T.punctuation_marks(body), length),
        "num_in_txt": F.regexp_count(body, F.lit("[0-9]+")),
        "_blanks": U.occurrences("body_text", " ") + 1,
    }


def _attributed(elements: Column) -> Column:
    """Elements that have attributes, with the values that the features look at."""

    def value(e: Column, name: str) -> Column:
        return F.coalesce(H.attribute(e, name), F.lit(""))

    def summary(e: Column) -> Column:
        names = ["class", "id", "href", "src", "name", "rel"]
        kind = F.lower(value(e, "type"))
        return F.struct(
            e["tag"].alias("tag"),
            *[value(e, n).alias(n) for n in names],
            F.when(kind == "", "text").otherwise(kind).alias("type"),
            F.transform(e["attrs"], lambda a: a["name"]).alias("has"),
        )

    with_attributes = F.filter(elements, lambda e: F.size(e["attrs"]) > 0)
    return F.transform(with_attributes, summary)


def _element_columns(as_of_year: int) -> dict[str, Column]:
    """Counts over the elements with attributes; tags without any are counted by name."""

    def count(test: str) -> Column:
        return F.expr(f"size(filter(_attributed, e -> {test}))")

    def any_element(test: str) -> Column:
        return U.flag(F.expr(f"exists(_attributed, e -> {test})"))

    def within(name: str, *pieces: str) -> str:
        return U.contains_any_sql(f"e.{name}", pieces)

    def external(tag: str, name: str) -> Column:
        return count(
            f"e.tag = '{tag}' AND startswith(e.{name}, 'http') "
            f"AND NOT contains(lower(e.{name}), _host)"
        )

    def handler(*names: str) -> Column:
        return count("(" + " OR ".join(f"array_contains(e.has, '{n}')" for n in names) + ")")

    bare_input = "CASE WHEN contains(_bare_text, '|input|') THEN array('text') ELSE array() END"
    input_types = "transform(filter(_attributed, e -> e.tag = 'input'), e -> e.type)"
    password = any_element("e.tag = 'input' AND e.type = 'password'")
    captcha = any_element(f"{within('class', 'captcha')} OR {within('id', 'captcha')}")
    return {
        "has_onclick": handler("onclick"),
        "has_onmouse": handler("onmouseover", "onmouseout", "onmousedown", "onmouseup"),
        "has_onload": handler("onload"),
        "nb_ext_links": external("a", "href"),
        "nb_ext_scripts": external("script", "src"),
        "nb_ext_imgs": external("img", "src"),
        "nb_input_types": F.expr(f"size(array_distinct(concat({input_types}, {bare_input})))"),
        "has_password_field": password,
        "has_login_form": password,
        "has_file_upload": any_element("e.tag = 'input' AND e.type = 'file'"),
        "has_captcha": F.greatest(U.flag(F.col("_lower").contains("captcha")), captcha),
        "has_date_stamps": U.occurrences("_bare_text", "|time|")
        + count("e.tag = 'time' OR array_contains(e.has, 'datetime')"),
        "has_new_badges": count(within("class", "new", "badge")),
        "has_copyright_year": U.flag(F.col("body_text").contains(str(as_of_year))),
        "nb_social_media_links": count(
            f"e.tag = 'a' AND {U.contains_any_sql('lower(e.href)', C.SOCIAL_SITES)}"
        ),
        "has_social_sharing": any_element(within("class", "share", "social")),
        "nb_social_buttons": count(within("class", "facebook", "twitter", "share")),
        "has_sus_ad_class": count(f"{within('class', 'ad', 'banner')} OR {within('id', 'ad')}"),
        "has_comment_sections": any_element(
            f"{within('class', 'comment')} OR {within('id', 'comment')}"
        ),
        "has_rating_system": any_element(within("class", "rating", "star", "review")),
        "has_search_box": any_element(
            f"(e.tag = 'input' AND e.type = 'search') OR {within('class', 'search')}"
        ),
        "has_view_port_meta": any_element("e.tag = 'meta' AND e.name = 'viewport'"),
        "has_responsive_imgs": U.occurrences("_bare_text", "|picture|")
        + count("e.tag = 'picture' OR (e.tag = 'img' AND array_contains(e.has, 'srcset'))"),
        "has_mobile_css": F.greatest(
            U.flag(F.col("style_text").contains("@media")),
            any_element(
                "e.tag = 'link' AND lower(e.rel) = 'stylesheet' AND contains(e.href, 'mobile')"
            ),
        ),
    }


def _ratio_columns() -> dict[str, Column]:
    length = F.col("content_txt_len")
    fields = F.col("nb_inputs") + F.col("nb_selects") + F.col("nb_textareas")
    return {
        "avg_words_per_sentence": F.col("avg_sentence_len"),
        "txt_to_html_ratio": F.try_divide(length, F.col("html_len")),
        "txt_to_tag_ratio": F.try_divide(length, F.col("total_elements")),
        "link_density": F.col("nb_a") / F.col("_blanks"),
        "img_density": F.col("nb_imgs") / F.col("_blanks"),
        "form_complexity": fields / F.greatest("nb_forms", F.lit(1)),
        "avg_paragraph_len": F.when(
            F.col("nb_paragraphs") > 0, length / F.col("nb_paragraphs")
        ).otherwise(F.lit(0.0)),
    }


def page_validity(df: DataFrame) -> DataFrame:
    """Add the validity report and ``is_alive`` to pages with text and tag counts.

    A page is dead if its HTTP status (where the snapshot has one) is 400 or more, or if its title
    or text holds an error phrase anywhere.
    """
    http_dead = F.col("status_code") >= 400 if "status_code" in df.columns else F.lit(False)
    # bound once: a predicate on is_alive must not copy the text expression for each phrase
    both = "array(concat(lower(title), '\\n', lower(body_text)))"
    said = F.expr(f"exists({both}, t -> {U.contains_any_sql('t', C.ERROR_PHRASES)})")
    return df.withColumns(
        {
            "has_error_indicators": U.flag(said),
            "content_length": F.length(
                F.regexp_replace(T.plain_spaces(F.col("body_text")), r"^\s+|\s+\z", "")
            ),
            "has_generic_structure": U.flag((F.col("nb_divs") < 3) & (F.col("nb_paragraphs") < 1)),
        }
    ).withColumns(
        {
            "is_minimal_content": U.flag(F.col("content_length") < 50),
            "is_alive": F.when(F.coalesce(http_dead, F.lit(False)), 0).otherwise(
                1 - F.col("has_error_indicators")
            ),
            "error_reason": F.when(
                F.coalesce(http_dead, F.lit(False)),
                "Page not accessible or redirected to error page",
            ).when(
                F.col("has_error_indicators") == 1,
                "Page appears to be an error/placeholder page",
            ),
        }
    )


def page_features_raw(pages: DataFrame, as_of_year: int) -> DataFrame:
    """Every page with its features and validity report, dead pages not yet emptied."""
    working = (
        with_page_tokens(spread(pages))
        .withColumns(
            {
                "_plain": T.plain_spaces(F.col("body_text")),
                "_elements": H.elements(F.col("_nodes")),
                "_tag_text": F.expr("concat('|', array_join(tags, '||'), '|')"),
                "_host": F.lower(U.host_of(U.url_netloc(F.col("url")))),
            }
        )
        .withColumns(
            {
                "_lower": F.lower("_plain"),
                "_clean": T.squeeze(F.col("_plain")),
                "_attributed": _attributed(F.col("_elements")),
                "_bare_text": F.expr(
                    "concat('|', array_join(transform(filter(_elements, "
                    "e -> size(e.attrs) = 0), e -> e.tag), '||'), '|')"
                ),
            }
        )
        .withColumns(
            {
                "_sentences": T.sentences(F.col("_clean")),
                "_pieces": F.split("_lower", r"\s+", -1),
            }
        )
    )
    measured = T.with_readability(working, "_clean", "_sentences").withColumns(
        _tag_counts() | _text_columns() | _element_columns(as_of_year)
    ).withColumns(_ratio_columns())
    helpers = [c for c in measured.columns if c.startswith("_")]
    return page_validity(measured).drop("tokens", "tags", *helpers)


def default_page_features() -> dict[str, float]:
    """Values of a dead or missing page: 0 everywhere, 1 for the empty title."""
    return {c: 1 if c == "is_empty_title" else 0 for c in C.PAGE_FEATURE_COLUMNS}


def fill_default_page_features(df: DataFrame, dead: str) -> DataFrame:
    """Replace the page features of the rows for which the SQL condition ``dead`` holds."""
    defaults = default_page_features()
    return df.withColumns(
        {c: F.expr(f"CASE WHEN {dead} THEN {v} ELSE {c} END") for c, v in defaults.items()}
    )


def page_features(pages: DataFrame, as_of_year: int) -> DataFrame:
    """page_id, url, the 75 page features (defaults for dead pages) and error_reason."""
    raw = page_features_raw(pages, as_of_year)
    filled = fill_default_page_features(raw, "is_alive = 0")
    return filled.select("page_id", "url", *C.PAGE_FEATURE_COLUMNS, "error_reason")


def redirect_detected(requested: Column, final: Column) -> Column:
    """1 where the crawl ended at another URL than the requested one, or nowhere."""
    return F.when(requested.eqNullSafe(F.coalesce(final, F.lit(""))), 0).otherwise(1)


def first_alive_candidate(
    requests: DataFrame, snapshot: DataFrame, key: str, requested: str
) -> DataFrame:
    """First alive URL to try per request: as given, else with https:// and then http:// in front.

    ``snapshot`` has ``url`` and ``is_alive``. Without a live candidate the result is NULL.
    """
    given = F.col(requested)
    options = F.when(given.rlike("^https?://"), F.array(given)).otherwise(
        F.array(F.concat(F.lit("https://"), given), F.concat(F.lit("http://"), given))
    )
    tries = requests.select(key, requested, F.posexplode(options).alias("_pos", "url"))
    alive = snapshot.filter("is_alive = 1").select("url", F.lit(True).alias("_ok")).distinct()
    ordered = F.struct("_pos", "url")
    return (
        tries.join(alive, "url", "left")
        .groupBy(key, requested)
        .agg(F.min(F.when(F.col("_ok"), ordered)).alias("_best"))
        .select(key, requested, F.col("_best.url").alias("candidate"))
    )
