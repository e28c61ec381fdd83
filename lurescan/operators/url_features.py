"""The URL feature job: one projection; snapshots join by domain with hot domains split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.functions import url as U
from lurescan.operators.tables import join_split_hot

#: A brand list inside the plan; a longer one is refused there (see :func:`brand_features_by_table`).
MOST_BRANDS = 100_000


def decompose(
    df: DataFrame, url: str = "url", suffix_rules: Sequence[str] = C.DEFAULT_SUFFIX_RULES
) -> DataFrame:
    """URL parts, registered domain and word lists, each computed once."""
    return U.with_words(U.with_registered_domain(U.with_url_parts(df, url), url, suffix_rules))


def _count_columns() -> dict[str, Column]:
    counts = {name: U.occurrences("url", char) for name, char in C.URL_CHARACTER_COUNTS.items()}
    last_start = "length(url) - length(element_at(split(url, '//', -1), -1)) - 2"
    dots = U.occurrences("url", ".")
    return counts | {
        "nb_tilde": U.flag(F.col("url").contains("~")),
        "nb_space": U.occurrences("url", " ", "%20"),
        "nb_dslash": U.flag(F.expr(f"contains(url, '//') AND {last_start} > 6")),
        "nb_subdomain": F.when(dots == 1, 1).when(dots == 2, 2).otherwise(3),
    }


def _part_columns() -> dict[str, Column]:
    u, path, tld = F.col("url"), F.lower("path"), F.col("tld")
    target = F.when(F.col("query") == "", F.col("path")).otherwise(
        F.concat_ws("?", "path", "query")
    )
    digits_url, digits_host = F.regexp_count(u, F.lit("[0-9]")), F.regexp_count(
        F.col("hostname"), F.lit("[0-9]")
    )
    tld_in_path = U.flag((tld == "") | path.contains(tld))
    tld_in_subdomain = U.flag((tld == "") | F.col("subdomain").contains(tld))
    return {
        "url_len": F.length(u),
        "hostname_len": F.length("hostname"),
        "entropy": U.entropy(F.col("_stripped")),
        "nb_http_token": F.regexp_count(target, F.lit("https?")),
        "nb_phish_hints": U.occurrences("lower(path)", *C.PHISH_HINTS),
        "has_ip": U.flag(u.rlike(C.HAS_IP_PATTERN)),
        "has_https": F.when(F.col("scheme") == "https", 0).otherwise(1),
        "has_punnycode": U.flag(u.startswith("http://xn--")),
        "has_port": U.flag(u.rlike(C.HAS_PORT_PATTERN)),
        "has_tld_in_path": tld_in_path,
        "has_tld_in_subdomain": tld_in_subdomain,
        "tld_in_bad_position": F.greatest(tld_in_path, tld_in_subdomain),
        "has_abnormal_subdomain": U.flag(u.rlike(C.ABNORMAL_SUBDOMAIN_PATTERN)),
        "has_prefix_suffix": U.flag(u.rlike(C.PREFIX_SUFFIX_PATTERN)),
        "has_short_svc": U.flag(U.contains_any("url", C.SHORTENER_HOSTS)),
        "has_path_txt_extension": U.flag(F.col("path").endswith(".txt")),
        "has_path_exe_extension": U.flag(F.col("path").endswith(".exe")),
        "has_sus_tld": U.flag(tld.isin(C.SUSPICIOUS_TLDS)),
        "ratio_digits_url": F.try_divide(digits_url, F.length(u)),
        "ratio_digits_host": F.coalesce(
            F.try_divide(digits_host, F.length("hostname")), F.lit(0.0)
        ),
        "count_digits": digits_url,
        "nb_parameters": U.occurrences("url", "&"),
        # corrected twins of rules whose published definition is unusual
        "has_ipv4_host": U.flag(
            F.col("hostname").rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$")
        ),
        "is_https": U.flag(F.col("scheme") == "https"),
    }


def _word_columns() -> dict[str, Column]:
    def containing(piece: str) -> Column:
        return F.size(F.filter("words", lambda w: w.contains(piece)))

    columns = {
        "word_raw_len": F.size("words"),
        "nb_www": containing("www"),
        "nb_com": containing("com"),
        "char_repeat": U.repeated_characters(F.col("words")),
    }
    for words, suffix in [("words", ""), ("words_host", "_host"), ("words_path", "_path")]:
        mean, longest, shortest = U.word_length_stats(F.col(words))
        columns[f"avg_word_raw{suffix}_len"] = mean
        columns[f"longest_word_raw{suffix}_len"] = longest
        columns[f"shortest_word_raw{suffix}_len"] = shortest
    return columns


def lexical_features(df: DataFrame) -> DataFrame:
    """All URL columns that need nothing but the decomposed URL."""
    no_host = F.lit("exception_init_or_extract: list index out of range")
    return (
        df.withColumn("_stripped", U.strip(F.col("url")))
        .withColumns(_count_columns() | _part_columns() | _word_columns())
        .withColumns(
            {
                "entropy_bits": F.abs("entropy"),
                "skip_reason": F.when(F.size("words_host") == 0, no_host),
            }
        )
        .drop("_stripped")
    )


def _interior_segments(path: Column) -> Column:
    """Dot-separated pieces of the path with a dot on both sides."""
    pieces = F.split(path, r"\.")
    return F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))


def brand_names(brands: Sequence[str] | DataFrame) -> list[str]:
    """Distinct brand names of a list or a table; more than ``MOST_BRANDS`` are an error."""
    if isinstance(brands, DataFrame):
        rows = brands.select(F.col(brands.columns[0]).alias("b")).filter("b IS NOT NULL").distinct()
        names = [r["b"] for r in rows.limit(MOST_BRANDS + 1).collect()]
    else:
        names = list(brands)
    if len(names) > MOST_BRANDS:
        raise ValueError(f"more than {MOST_BRANDS} brands")
    return sorted(names)


def brand_features(df: DataFrame, brands: Sequence[str] | DataFrame) -> DataFrame:
    """has_domain_in_brand, has_brand_in_path and has_brand_in_subdomain.

    The brands are a hash set inside the projection, so nothing is shuffled.
    """
    names = brand_names(brands)
    listed = ", ".join(U.sql_text(n) for n in names) or "NULL"

    def hit(pieces: str) -> str:
        return f"exists({pieces}, p -> p IN ({listed}) AND NOT contains(domain, p))"

    in_path = [hit("_interior")] + [
        f"contains(path, {U.sql_text('.' + n + '.')}) AND NOT contains(domain, {U.sql_text(n)})"
        for n in names
        if "." in n
    ]
    return (
        df.withColumn("_interior", _interior_segments(F.col("path")))
        .withColumns(
            {
                "has_domain_in_brand": U.flag(F.expr(f"get(words_host, 0) IN ({listed})")),
                "has_brand_in_path": U.flag(F.expr(" OR ".join(in_path))),
                "has_brand_in_subdomain": U.flag(F.expr(hit(r"split(subdomain, '[.]')"))),
            }
        )
        .drop("_interior")
    )


def _row_key(*columns: str) -> Column:
    """One string for several columns, each with its length in front, so that no two rows share it by chance."""
    parts = [F.concat(F.coalesce(F.length(c), F.lit(-1)), F.lit(":"), F.coalesce(F.col(c), F.lit(""))) for c in columns]
    return F.concat(*parts)


def _places(segments: str) -> str:
    """SQL of the runs of neighbouring segments with as many of them as some brand has (column ``_sizes``)."""
    run = f"array_join(slice({segments}, i, k), '.')"
    starts = f"sequence(1, size({segments}) - k + 1)"
    return f"flatten(transform(filter(_sizes, k -> k <= size({segments})), k -> transform({starts}, i -> {run})))"


def brand_hits(df: DataFrame, brands: DataFrame) -> DataFrame:
    """``_brand_key, _in_word, _in_path, _in_subdomain``: the hosts and paths where a brand stands.

    A brand of k dotted parts is looked for among the runs of k segments with a dot on both sides, as an equi
    join, so neither the number of brands nor their length is bounded. The numbers of parts that occur are one
    row. A segment that many paths have is spread over several tasks.
    """
    names = brands.select(F.col(brands.columns[0]).alias("_brand")).filter("_brand IS NOT NULL").distinct()
    sizes = names.select(F.size(F.split("_brand", "[.]")).alias("k"))
    sizes = sizes.agg(F.array_sort(F.collect_set("k")).alias("_sizes"))
    narrow = df.select(
        "_brand_key", "domain", "subdomain", F.get("words_host", F.lit(0)).alias("_word"),
        _interior_segments(F.col("path")).alias("_interior"),
    ).dropDuplicates(["_brand_key"])
    sized = narrow.withColumn("_sizes", sizes.scalar())
    kinds = {"word": "array(_word)", "path": _places("_interior"), "subdomain": "split(subdomain, '[.]')"}
    pieces = F.concat(*[
        F.expr(f"transform(array_distinct({p}), v -> named_struct('kind', '{k}', 'piece', v))") for k, p in kinds.items()
    ])
    each = sized.select("_brand_key", "domain", F.explode(pieces).alias("p")).select("_brand_key", "domain", "p.*")
    found = join_split_hot(each, names.withColumnRenamed("_brand", "piece"), "piece", "inner")
    counted = found.filter("kind = 'word' OR NOT contains(domain, piece)")
    return counted.groupBy("_brand_key").agg(*[F.max(U.flag(F.col("kind") == k)).alias(f"_in_{k}") for k in kinds])


def brand_features_by_table(df: DataFrame, brands: DataFrame) -> DataFrame:
    """The columns of :func:`brand_features` for a table of brands of any number and length.

    Only hosts and paths with a brand come back to the rows, by one join.
    """
    word = F.get("words_host", F.lit(0))
    keyed = df.withColumn("_word", word).withColumn("_brand_key", _row_key("_word", "subdomain", "domain", "path"))
    hits = brand_hits(keyed, brands)
    flags = {"has_domain_in_brand": "_in_word", "has_brand_in_path": "_in_path", "has_brand_in_subdomain": "_in_subdomain"}
    return (
        join_split_hot(keyed, hits, "_brand_key")
        .withColumns({name: F.coalesce(c, F.lit(0)) for name, c in flags.items()})
        .drop("_brand_key", "_word", *flags.values())
    )


def brand_lookalikes(df: DataFrame, brands: DataFrame) -> DataFrame:
    """Distinct first host words with a brand at edit distance 0 or 1.

    Two words within one edit share themselves or a form with one character deleted, so an equi
    join on those forms finds every pair and ``levenshtein`` confirms it.
    """

    def forms(word: Column) -> Column:
        shorter = F.transform(
            F.sequence(F.lit(1), F.length(word)),
            lambda i: F.concat(
                F.substring(word, F.lit(1), i - 1),
                F.substring(word, i + 1, F.length(word)),
            ),
        )
        return F.array_distinct(F.concat(F.array(word), shorter))

    words = (
        df.select(F.get("words_host", F.lit(0)).alias("word")).filter("word is not null").distinct()
    )
    names = brands.select(F.lower(F.col(brands.columns[0])).alias("brand")).filter(
        "brand != ''"
    ).distinct()
    return (
        words.withColumn("form", F.explode(forms(F.col("word"))))
        .join(names.withColumn("form", F.explode(forms(F.col("brand")))), "form")
        .filter(F.levenshtein("word", "brand", 1) >= 0)
        .groupBy("word")
        .agg(F.countDistinct("brand").alias("n_brands"))
    )


def with_lookalike_flag(df: DataFrame, brands: DataFrame) -> DataFrame:
    """Add has_domain_in_brand1."""
    hits = brand_lookalikes(df, brands).select("word", F.lit(1).alias("_hit"))
    worded = df.withColumn("word", F.get("words_host", F.lit(0)))
    return join_split_hot(worded, hits, "word").withColumn(
        "has_domain_in_brand1", F.coalesce("_hit", F.lit(0))
    ).drop("word", "_hit")


def addresses(dns_snapshot: DataFrame) -> DataFrame:
    """One address per domain."""
    return dns_snapshot.groupBy("domain").agg(F.min("ip").alias("_ip"))


def report_flag(url: str = "url", address: str = "_ip") -> Column:
    """has_statistical_report; no address means the lookup failed."""
    reported = U.contains_any(url, C.REPORTED_HOSTS) | U.contains_any(address, C.REPORTED_IPS)
    return (
        F.when(F.col(address).isNull(), 2)
        .when(reported, 1)
        .when(F.col(address) == C.UNRESOLVED_SENTINEL_IP, 2)
        .otherwise(0)
    )


def statistical_report(df: DataFrame, dns_snapshot: DataFrame) -> DataFrame:
    """has_statistical_report from a ``dns_snapshot(domain, ip)``; no row means the lookup failed."""
    joined = join_split_hot(df, addresses(dns_snapshot), "domain")
    return joined.withColumn("has_statistical_report", report_flag()).drop("_ip")


def redirect_features(df: DataFrame, chain: str | None = None) -> DataFrame:
    """nb_redirection and nb_e_redirection from an array column of hops, -1 without one."""
    if chain is None:
        return df.withColumns({"nb_redirection": F.lit(-1), "nb_e_redirection": F.lit(-1)})
    outside = F.filter(
        F.col(chain), lambda hop: ~F.lower(hop).contains(F.lower(F.col("domain")))
    )
    missing = F.col(chain).isNull()
    return df.withColumns(
        {
            "nb_redirection": F.when(missing, -1).otherwise(F.size(chain)),
            "nb_e_redirection": F.when(missing, -1).otherwise(F.size(outside)),
        }
    )


def url_features(
    df: DataFrame,
    brands: Sequence[str] | DataFrame,
    dns_snapshot: DataFrame,
    suffix_rules: Sequence[str] = C.DEFAULT_SUFFIX_RULES,
    redirect_chain: str | None = None,
    brands_by_table: bool = False,
) -> DataFrame:
    """Input columns, URL parts and the 57 URL features (``skip_reason`` marks unusable rows)."""
    reported = statistical_report(decompose(df, "url", suffix_rules), dns_snapshot)
    return described(reported, brands, redirect_chain, brands_by_table)


def described(
    df: DataFrame, brands: Sequence[str] | DataFrame, redirect_chain: str | None = None, brands_by_table: bool = False
) -> DataFrame:
    """The URL features of decomposed rows that have has_statistical_report already."""
    branded = brand_features_by_table(df, brands) if brands_by_table else brand_features(df, brands)
    return lexical_features(redirect_features(branded, redirect_chain))
