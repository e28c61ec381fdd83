"""URL rules as Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.operators.tables import join_split_hot

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)"
_IPV4 = r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    Catalyst copies the definition of a column into every place a pushed-down predicate names it.
    A bound value keeps such a copy from growing with each use.
    """
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def sql_text(text: str) -> str:
    """SQL literal of a string."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def occurrences_sql(text: str, piece: str) -> str:
    """Number of non-overlapping occurrences of a fixed string in the SQL expression ``text``."""
    removed = f"length({text}) - length(replace({text}, {sql_text(piece)}, ''))"
    return f"(({removed}) div {len(piece)})"


def occurrences(text: str, *pieces: str) -> Column:
    """Occurrences of all the fixed strings together."""
    return F.expr(" + ".join(occurrences_sql(text, p) for p in pieces)).cast("int")


def any_of(strings: Sequence[str]) -> str:
    return "|".join(re.escape(s) for s in strings)


def contains_any_sql(text: str, pieces: Sequence[str]) -> str:
    """One of the fixed strings occurs: byte searches, cheaper than a pattern of alternatives."""
    return "(" + " OR ".join(f"contains({text}, {sql_text(p)})" for p in pieces) + ")"


def contains_any(text: str, pieces: Sequence[str]) -> Column:
    return F.expr(contains_any_sql(text, pieces))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, _AUTHORITY, 1)


def host_of(netloc: Column) -> Column:
    """Host without user info, port and brackets; the letter case is kept."""
    address = F.regexp_replace(netloc, r"^.*@", "")
    return F.when(
        address.contains("["), F.regexp_extract(address, r"\[([^\]]*)", 1)
    ).otherwise(F.regexp_extract(address, r"^([^:]*)", 1))


def hostname_of(netloc: Column) -> Column:
    """Lower-case host; what follows a ``%`` keeps its case, as a zone identifier does."""
    host = host_of(netloc)
    return F.concat(
        F.lower(F.regexp_extract(host, r"^([^%]*)", 1)), F.regexp_extract(host, r"((?s)%.*)$", 1)
    )


def _url_parts(url: Column) -> Column:
    """Struct of scheme, netloc, hostname, path, params, query and fragment of a cleaned URL."""
    rest = F.regexp_replace(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?", "")

    def parts(netloc: Column, tail: Column) -> Column:
        full_path = F.regexp_extract(tail, r"^([^?#]*)", 1)
        named = {
            "scheme": url_scheme(url),
            "netloc": netloc,
            "hostname": hostname_of(netloc),
            "path": F.regexp_replace(full_path, r";[^/]*$", ""),
            "params": F.regexp_extract(full_path, r";([^/]*)$", 1),
            "query": F.regexp_extract(tail, r"^[^?#]*\?([^#]*)", 1),
            "fragment": F.regexp_extract(tail, r"#((?s).*)$", 1),
        }
        broken = netloc.contains("[") != netloc.contains("]")
        empty = F.struct(*[F.lit("").alias(name) for name in named])
        return F.when(broken, empty).otherwise(
            F.struct(*[part.alias(name) for name, part in named.items()])
        )

    return let(url_netloc(url), lambda netloc: let(rest, lambda tail: parts(netloc, tail)))


URL_PARTS = ["scheme", "netloc", "hostname", "path", "params", "query", "fragment"]


def with_url_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Add scheme, netloc, hostname, path, params, query and fragment, '' where there is none.

    Unbalanced brackets in the authority make every part empty, like any other URL that cannot be
    split.
    """
    cleaned = F.regexp_replace(
        F.regexp_replace(F.col(url), r"^[\x00-\x20]+", ""), r"[\t\r\n]", ""
    )
    return (
        df.withColumn("_parts", let(cleaned, _url_parts))
        .withColumns({name: F.coalesce(f"_parts.{name}", F.lit("")) for name in URL_PARTS})
        .drop("_parts")
    )


def with_registered_domain(
    df: DataFrame, url: str = "url", suffix_rules: Sequence[str] = C.DEFAULT_SUFFIX_RULES
) -> DataFrame:
    """Add subdomain, domain and tld by the longest matching public-suffix rule.

    ``suffix_rules`` holds normal rules (``co.uk``), wildcards (``*.ck``) and exceptions
    (``!www.ck``). A published list has some thousand lines, so it is given inline: membership is a
    hash-set test inside the projection and the rows are never shuffled. Needs ``hostname`` from
    :func:`with_url_parts`. A host may come without a scheme here, unlike in ``hostname``.
    """
    exact = [r for r in suffix_rules if not r.startswith(("*.", "!"))]
    wild = [r[2:] for r in suffix_rules if r.startswith("*.")]
    exceptions = [r[1:] for r in suffix_rules if r.startswith("!")]

    def parent(name: Column) -> Column:
        return F.when(name.contains("."), F.regexp_replace(name, r"^[^.]*\.", ""))

    def is_suffix(name: Column) -> Column:
        rule = name.isin(exact) if exact else F.lit(False)
        return (rule | F.coalesce(parent(name).isin(wild), F.lit(False))) if wild else rule

    def suffix(labels: Column) -> Column:
        n = F.size(labels)
        endings = F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.lower(F.array_join(F.slice(labels, i, n), ".")),
        )
        found = let(endings, lambda e: longest(e))
        return F.coalesce(found, F.lit(""))

    def longest(endings: Column) -> Column:
        found = F.get(F.filter(endings, lambda e: is_suffix(e)), F.lit(0))
        if not exceptions:
            return found
        kept = F.get(F.filter(endings, lambda e: e.isin(exceptions)), F.lit(0))
        return F.coalesce(parent(kept), found)

    return _with_site(df, _address(url), suffix)


def _address(url: str) -> Column:
    """The host as it stands between ``//`` and the path, without user and port; a scheme may be missing."""
    address = F.regexp_extract(
        F.regexp_replace(F.col(url), r"^(?:[A-Za-z0-9+.\-]*:)?//", ""), r"^([^/?#]*)", 1
    )
    address = F.regexp_replace(address, r"^.*@", "")

    def bare(address: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(address, r":[^:]*$", ""), r"[\s.]+$", "")
        bracketed = F.regexp_extract(address, r"^(\[[^\]]*\]?)", 1)
        return F.when(address.startswith("["), bracketed).otherwise(plain)

    return let(address, bare)


def _is_address(host: Column) -> Column:
    return host.rlike(_IPV4) | host.startswith("[")


def _with_site(df: DataFrame, host: Column, suffix: Callable[[Column], Column]) -> DataFrame:
    """Add subdomain, domain and tld; ``suffix`` gives the public suffix of a host's labels, '' without one."""
    def site(host: Column, labels: Column, tld: Column) -> Column:
        used = F.when(tld == "", 0).otherwise(F.size(F.split(tld, r"\.")))
        return let(F.size(labels) - used, lambda keep: named_site(host, labels, tld, keep))

    def named_site(host: Column, labels: Column, tld: Column, keep: Column) -> Column:
        name = F.when(keep > 0, F.get(labels, keep - 1)).otherwise(F.lit(""))
        under = F.array_join(F.slice(labels, F.lit(1), F.greatest(keep - 1, F.lit(0))), ".")
        domain = (
            F.when(name == "", F.col("hostname"))
            .when(tld == "", name)
            .otherwise(F.concat(name, F.lit("."), tld))
        )
        return F.struct(under.alias("subdomain"), domain.alias("domain"), tld.alias("tld"))

    def of_host(host: Column) -> Column:
        address = F.struct(
            F.lit("").alias("subdomain"), host.alias("domain"), F.lit("").alias("tld")
        )
        named = let(
            F.split(host, r"\."),
            lambda labels: let(suffix(labels), lambda tld: site(host, labels, tld)),
        )
        return F.when(_is_address(host), address).otherwise(named)

    return (
        df.withColumn("_site", let(host, of_host))
        .withColumns(
            {c: F.coalesce(f"_site.{c}", F.lit("")) for c in ("subdomain", "domain", "tld")}
        )
        .drop("_site")
    )


def suffix_table(rules: DataFrame) -> DataFrame:
    """``name, shift`` of public-suffix rules in a column ``rule``; repeats and empty rules go.

    ``shift`` is how many labels left of the name the suffix begins: 0 for a normal rule, 1 for a
    wildcard, -1 for an exception.
    """
    rule = F.col("rule")
    return rules.select(
        F.when(rule.startswith("*."), F.substring(rule, 3, 1 << 20)).when(rule.startswith("!"), F.substring(rule, 2, 1 << 20))
        .otherwise(rule).alias("name"),
        F.when(rule.startswith("*."), 1).when(rule.startswith("!"), -1).otherwise(0).alias("shift"),
    ).filter("name != ''").distinct()


def with_registered_domain_by_table(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """:func:`with_registered_domain` with rules of any number, as a table with a column ``rule``.

    Each distinct host is looked up once: its endings, one per label, meet the rules in an equi join, and
    the suffixes come back by host. Needs ``hostname`` from :func:`with_url_parts`. Endings and hosts that many rows share are spread
    (:func:`lurescan.operators.tables.join_split_hot`).
    """
    hosted = df.withColumn("_host", _address(url))
    hosts = hosted.select("_host").filter(~_is_address(F.col("_host"))).distinct()
    labels = F.split("_host", r"\.")
    endings = hosts.select("_host", F.posexplode(labels).alias("_at", "_label"), labels.alias("_labels")).select(
        "_host", "_at", F.size("_labels").alias("_n"), F.lower(F.array_join(F.slice("_labels", F.col("_at") + 1, F.size("_labels")), ".")).alias("_ending"))
    met = join_split_hot(endings, suffix_table(rules).withColumnRenamed("name", "_ending"), "_ending", "inner")
    begin = F.col("_at") - F.col("shift")
    # the longest exception counts before the longest other rule; a wildcard needs a label of its own
    first = met.filter((begin >= 0) & (begin < F.col("_n"))).groupBy("_host").agg(
        F.coalesce(F.min(F.when(F.col("shift") < 0, begin)), F.min(F.when(F.col("shift") >= 0, begin))).alias("_begin"))
    found = join_split_hot(hosted, first, "_host")

    def suffix(labels: Column) -> Column:
        tld = F.lower(F.array_join(F.slice(labels, F.col("_begin") + 1, F.size(labels)), "."))
        return F.when(F.col("_begin").isNull(), "").otherwise(tld)

    return _with_site(found, F.col("_host"), suffix).drop("_host", "_begin")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), C.WORD_SEPARATORS), lambda w: w != "")


def with_words(df: DataFrame) -> DataFrame:
    """Add words, words_host and words_path; the query string gives no words."""
    return (
        df.withColumns(
            {
                "_domain_words": words_of(F.col("domain")),
                "_subdomain_words": words_of(F.col("subdomain")),
                "words_path": words_of(F.col("path")),
            }
        )
        .withColumns(
            {
                "words": F.concat("_domain_words", "words_path", "_subdomain_words"),
                "words_host": F.concat("_domain_words", "_subdomain_words"),
            }
        )
        .drop("_domain_words", "_subdomain_words")
    )


def is_valid_url(url: Column) -> Column:
    return url.rlike(C.VALID_URL_PATTERN) & (url_scheme(url) != "") & (url_netloc(url) != "")


def scan_target(url: Column, scan_mode: Column) -> Column:
    """URL that is scored: ``scheme://netloc`` in domain mode, else the stripped URL."""
    stripped = strip(url)
    site = F.concat(url_scheme(stripped), F.lit("://"), url_netloc(stripped))
    return F.when(scan_mode == "domain", site).otherwise(stripped)


def domain_hash(url: Column) -> Column:
    netloc = F.lower(url_netloc(url))
    return F.sha2(F.when(netloc == "", url).otherwise(netloc), 256)


def cache_key(url: Column, model: Column, scan_mode: Column) -> Column:
    return F.concat(domain_hash(url), F.lit(":"), model, F.lit("_"), scan_mode)


def page_key(url: Column) -> Column:
    return F.md5(url)


def entropy(text: Column) -> Column:
    """Sum of p*log2(p) over the characters: zero or negative, as the feature is defined.

    ``text`` should be a plain column, because it is read once per distinct character.
    """
    chars = F.split(text, "")
    n = F.length(text)

    def term(char: Column) -> Column:
        p = (n - F.length(F.replace(text, char, F.lit("")))) / n
        return p * F.log2(p)

    total = F.aggregate(
        F.transform(F.array_distinct(chars), term), F.lit(0.0), lambda acc, x: acc + x
    )
    return F.when(n == 0, F.lit(0.0)).otherwise(total)


def repeated_characters(words: Column) -> Column:
    """Windows of 2 to 5 equal characters inside the words.

    A run of length L holds L-1 windows of two, L-2 of three and so on, so the runs suffice.
    """
    runs = F.regexp_extract_all(F.array_join(words, "-"), F.lit(r"(.)\1+"), F.lit(0))

    def windows(run: Column) -> Column:
        longer = [F.greatest(F.length(run) - k, F.lit(0)) for k in (1, 2, 3, 4)]
        return longer[0] + longer[1] + longer[2] + longer[3]

    return F.aggregate(F.transform(runs, windows), F.lit(0), lambda acc, x: acc + x)


def word_length_stats(words: Column) -> tuple[Column, Column, Column]:
    """Mean, longest and shortest word length, 0 for no words."""
    lengths = F.transform(words, F.length)
    total = F.aggregate(lengths, F.lit(0), lambda acc, x: acc + x)
    return (
        F.when(F.size(words) > 0, total / F.size(words)).otherwise(F.lit(0.0)),
        F.coalesce(F.array_max(lengths), F.lit(0)),
        F.coalesce(F.array_min(lengths), F.lit(0)),
    )
