"""URL decomposition and URL features over ``pages.url``."""

from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.functions import url as U
from lurescan.operators import url_features as UF
from lurescan.plans.registry import Tables, query

# The sites of the test pages are subdomains of three hosting domains, given as private suffixes.
SUFFIX_RULES = C.DEFAULT_SUFFIX_RULES + ["example.com", "example.net", "example.org"]


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


RFC = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

# Common SQL: URL parts, registered domain, words.
PARTS_SQL = rf"""
raw AS (
  SELECT page_id, url,
         lower(regexp_extract(url, '{RFC}', 2)) AS scheme,
         regexp_extract(url, '{RFC}', 4) AS netloc,
         regexp_extract(url, '{RFC}', 5) AS full_path,
         regexp_extract(url, '{RFC}', 7) AS query,
         regexp_extract(url, '{RFC}', 9) AS fragment
  FROM pages),
parts AS (
  SELECT *, lower(regexp_replace(regexp_replace(netloc, '^.*@', ''), ':[0-9]*$', '')) AS hostname,
         regexp_replace(full_path, ';[^/]*$', '') AS path,
         regexp_extract(full_path, ';([^/]*)$', 1) AS params
  FROM raw),
labels_of AS (SELECT *, string_split(hostname, '.') AS host_labels FROM parts),
suffixes AS (
  SELECT l.page_id, max(len(l.host_labels) - i.n + 1) AS n_suffix
  FROM labels_of l, (SELECT unnest(range(1, 20)) AS n) i
  WHERE i.n <= len(l.host_labels)
    AND list_contains({sql_list(SUFFIX_RULES)}, array_to_string(l.host_labels[i.n:], '.'))
  GROUP BY l.page_id),
sites AS (
  SELECT l.*, coalesce(s.n_suffix, 0) AS k,
         array_to_string(l.host_labels[len(l.host_labels) - coalesce(s.n_suffix, 0) + 1:], '.') AS tld,
         l.host_labels[len(l.host_labels) - coalesce(s.n_suffix, 0)] AS name,
         array_to_string(l.host_labels[1:len(l.host_labels) - coalesce(s.n_suffix, 0) - 1], '.') AS subdomain
  FROM labels_of l LEFT JOIN suffixes s USING (page_id)),
split AS (
  SELECT *, CASE WHEN name IS NULL THEN hostname WHEN tld = '' THEN name
                 ELSE name || '.' || tld END AS domain
  FROM sites),
worded AS (
  SELECT *, list_filter(string_split_regex(lower(domain), '[-./?=@&%:_]'), lambda w: w <> '') AS wd,
         list_filter(string_split_regex(lower(path), '[-./?=@&%:_]'), lambda w: w <> '') AS words_path,
         list_filter(string_split_regex(lower(subdomain), '[-./?=@&%:_]'), lambda w: w <> '') AS ws
  FROM split),
urls AS (
  SELECT *, wd || words_path || ws AS words, wd || ws AS words_host FROM worded)
"""


def decomposed(t: Tables):
    """The pages' URL parts; the plan is built once per set of tables."""
    if "_decomposed" not in vars(t):
        t._decomposed = UF.decompose(t.pages.select("page_id", "url"), "url", SUFFIX_RULES)
    return t._decomposed


def www_brands(t: Tables):
    """Brand list: names of the sites that are served under ``www``."""
    return (
        decomposed(t)
        .filter("subdomain = 'www'")
        .select(F.regexp_extract("domain", r"^([^.]*)", 1).alias("brand"))
        .distinct()
    )


BRANDS_SQL = r"""
brands AS (SELECT DISTINCT regexp_extract(domain, '^([^.]*)', 1) AS brand FROM urls
           WHERE subdomain = 'www')
"""


def dns_snapshot(t: Tables):
    """Address per site, spread by its md5: some missing, some reported."""
    code = F.substring(F.md5("domain"), 1, 1)
    return (
        decomposed(t)
        .select("domain")
        .distinct()
        .filter(~code.isin("0", "1", "2", "3"))
        .select(
            "domain",
            F.when(code == "4", "10.10.10.10")
            .when(code == "5", "125.235.4.59")
            .otherwise(F.concat(F.lit("93.184.216."), F.length("domain")))
            .alias("ip"),
        )
    )


DNS_SQL = """
dns AS (SELECT DISTINCT domain,
               CASE substr(md5(domain), 1, 1) WHEN '4' THEN '10.10.10.10'
                    WHEN '5' THEN '125.235.4.59'
                    ELSE '93.184.216.' || length(domain) END AS ip
        FROM urls WHERE substr(md5(domain), 1, 1) NOT IN ('0', '1', '2', '3'))
"""


@query(
    "url_parts",
    "page_id:i scheme:s netloc:s hostname:s path:s params:s query:s fragment:s",
    f"WITH {PARTS_SQL} SELECT * FROM parts",
)
def url_parts(t: Tables):
    return U.with_url_parts(t.pages.select("page_id", "url"))


@query(
    "registered_domain",
    "page_id:i subdomain:s domain:s tld:s",
    f"WITH {PARTS_SQL} SELECT * FROM split",
)
def registered_domain(t: Tables):
    return U.with_registered_domain(
        U.with_url_parts(t.pages.select("page_id", "url")), "url", SUFFIX_RULES
    )


@query(
    "registered_domain_by_table",
    "page_id:i subdomain:s domain:s tld:s",
    f"WITH {PARTS_SQL} SELECT * FROM split",
)
def registered_domain_by_table(t: Tables):
    rules = t.spark.createDataFrame([(r,) for r in SUFFIX_RULES], "rule string")
    return U.with_registered_domain_by_table(U.with_url_parts(t.pages.select("page_id", "url")), rules, "url")


@query(
    "url_words",
    "page_id:i words:s words_host:s words_path:s n_words:i",
    f"""WITH {PARTS_SQL}
    SELECT page_id, array_to_string(words, ' ') AS words, array_to_string(words_host, ' ') AS words_host,
           array_to_string(words_path, ' ') AS words_path, len(words) AS n_words FROM urls""",
)
def url_words(t: Tables):
    return decomposed(t).select(
        "page_id",
        *[F.array_join(c, " ").alias(c) for c in ("words", "words_host", "words_path")],
        F.size("words").alias("n_words"),
    )


@query(
    "url_validity",
    "page_id:i is_valid:i domain_target:s full_target:s domain_key:s page_key:s",
    rf"""WITH {PARTS_SQL}
    SELECT page_id,
           CAST(regexp_matches(url, '^https?://[^\s/$.?#].[^\s]*$') AND scheme <> '' AND netloc <> '' AS INT) AS is_valid,
           scheme || '://' || netloc AS domain_target, trim(url) AS full_target,
           sha256(CASE WHEN netloc = '' THEN url ELSE lower(netloc) END) || ':rf_domain' AS domain_key,
           md5(url) AS page_key
    FROM parts""",
)
def url_validity(t: Tables):
    url = F.col("url")
    return t.pages.select(
        "page_id",
        U.is_valid_url(url).alias("is_valid"),
        U.scan_target(url, F.lit("domain")).alias("domain_target"),
        U.scan_target(url, F.lit("full")).alias("full_target"),
        U.cache_key(url, F.lit("rf"), F.lit("domain")).alias("domain_key"),
        U.page_key(url).alias("page_key"),
    )


_COUNTED = list(C.URL_CHARACTER_COUNTS.items())


@query(
    "url_character_counts",
    "page_id:i "
    + " ".join(f"{n}:i" for n, _ in _COUNTED)
    + " nb_tilde:i nb_space:i nb_dslash:i nb_subdomain:i",
    "SELECT page_id, "
    + ", ".join(f"len(string_split(url, '{ch}')) - 1 AS {n}" for n, ch in _COUNTED)
    + """, CASE WHEN contains(url, '~') THEN 1 ELSE 0 END AS nb_tilde,
      len(string_split(url, ' ')) + len(string_split(url, '%20')) - 2 AS nb_space,
      CASE WHEN len(string_split(url, '//')) > 1
            AND length(url) - length(string_split(url, '//')[-1]) - 2 > 6 THEN 1 ELSE 0 END AS nb_dslash,
      CASE len(string_split(url, '.')) WHEN 2 THEN 1 WHEN 3 THEN 2 ELSE 3 END AS nb_subdomain
    FROM pages""",
)
def url_character_counts(t: Tables):
    return t.pages.select("page_id", "url").withColumns(UF._count_columns())


_BOOL = "CASE WHEN {} THEN 1 ELSE 0 END AS {}"


@query(
    "url_flags",
    "page_id:i nb_http_token:i nb_phish_hints:i has_ip:i has_https:i has_punnycode:i has_port:i "
    "has_tld_in_path:i has_tld_in_subdomain:i tld_in_bad_position:i has_abnormal_subdomain:i "
    "has_prefix_suffix:i has_short_svc:i has_path_txt_extension:i has_path_exe_extension:i "
    "has_sus_tld:i is_https:i has_ipv4_host:i",
    rf"""WITH {PARTS_SQL}
    SELECT page_id,
      len(regexp_extract_all(path || CASE WHEN query = '' THEN '' ELSE '?' || query END, 'https?')) AS nb_http_token,
      {" + ".join(f"(len(string_split(lower(path), '{h}')) - 1)" for h in C.PHISH_HINTS)} AS nb_phish_hints,
      {_BOOL.format("regexp_matches(url, '" + C.HAS_IP_PATTERN + "')", "has_ip")},
      CASE WHEN scheme = 'https' THEN 0 ELSE 1 END AS has_https,
      {_BOOL.format("starts_with(url, 'http://xn--')", "has_punnycode")},
      {_BOOL.format("regexp_matches(url, '" + C.HAS_PORT_PATTERN.replace("'", "''") + "')", "has_port")},
      {_BOOL.format("contains(lower(path), tld)", "has_tld_in_path")},
      {_BOOL.format("contains(subdomain, tld)", "has_tld_in_subdomain")},
      {_BOOL.format("contains(lower(path), tld) OR contains(subdomain, tld)", "tld_in_bad_position")},
      {_BOOL.format("regexp_matches(url, '" + C.ABNORMAL_SUBDOMAIN_PATTERN + "')", "has_abnormal_subdomain")},
      {_BOOL.format("regexp_matches(url, '" + C.PREFIX_SUFFIX_PATTERN + "')", "has_prefix_suffix")},
      {_BOOL.format(" OR ".join(f"contains(url, '{h}')" for h in C.SHORTENER_HOSTS), "has_short_svc")},
      {_BOOL.format("path LIKE '%.txt'", "has_path_txt_extension")},
      {_BOOL.format("path LIKE '%.exe'", "has_path_exe_extension")},
      {_BOOL.format("list_contains(" + sql_list(C.SUSPICIOUS_TLDS) + ", tld)", "has_sus_tld")},
      CASE WHEN scheme = 'https' THEN 1 ELSE 0 END AS is_https,
      {_BOOL.format("regexp_matches(hostname, '^[0-9]{1,3}([.][0-9]{1,3}){3}$')", "has_ipv4_host")}
    FROM urls""",
)
def url_flags(t: Tables):
    return UF.lexical_features(decomposed(t))


@query(
    "url_entropy",
    "page_id:i entropy:d entropy_bits:d",
    """WITH chars AS (SELECT page_id, length(trim(url)) AS n, unnest(string_split(trim(url), '')) AS ch FROM pages),
    counts AS (SELECT page_id, n, ch, count(*) AS k FROM chars GROUP BY page_id, n, ch)
    SELECT page_id, sum(k / n * log2(k / n)) AS entropy, -sum(k / n * log2(k / n)) AS entropy_bits
    FROM counts GROUP BY page_id""",
)
def url_entropy(t: Tables):
    stripped = t.pages.select("page_id", U.strip(F.col("url")).alias("stripped"))
    valued = stripped.withColumn("entropy", U.entropy(F.col("stripped")))
    return valued.withColumn("entropy_bits", F.abs("entropy"))


@query(
    "url_lengths",
    "page_id:i url_len:i hostname_len:i ratio_digits_url:d ratio_digits_host:d count_digits:i nb_parameters:i",
    f"""WITH {PARTS_SQL}
    SELECT page_id, length(url) AS url_len, length(hostname) AS hostname_len,
      length(regexp_replace(url, '[^0-9]', '', 'g')) / length(url) AS ratio_digits_url,
      CASE WHEN hostname = '' THEN 0 ELSE length(regexp_replace(hostname, '[^0-9]', '', 'g')) / length(hostname) END AS ratio_digits_host,
      length(regexp_replace(url, '[^0-9]', '', 'g')) AS count_digits,
      len(string_split(url, '&')) - 1 AS nb_parameters
    FROM parts""",
)
def url_lengths(t: Tables):
    return UF.lexical_features(decomposed(t))


def _stats_sql(words: str, suffix: str) -> str:
    lengths = f"list_transform({words}, lambda w: length(w))"
    return f"""coalesce(list_avg({lengths}), 0) AS avg_word_raw{suffix}_len,
      coalesce(list_max({lengths}), 0) AS longest_word_raw{suffix}_len,
      coalesce(list_min({lengths}), 0) AS shortest_word_raw{suffix}_len"""


@query(
    "url_word_features",
    "page_id:i word_raw_len:i nb_www:i nb_com:i char_repeat:i "
    + " ".join(
        f"avg_word_raw{s}_len:d longest_word_raw{s}_len:i shortest_word_raw{s}_len:i"
        for s in ("", "_host", "_path")
    ),
    f"""WITH {PARTS_SQL},
    each AS (SELECT page_id, unnest(words) AS w FROM urls),
    windows AS (
      SELECT e.page_id, count(*) AS n FROM each e, (SELECT unnest(range(2, 6)) AS k) s,
             (SELECT unnest(range(1, 400)) AS i) p
      WHERE p.i + s.k - 1 <= length(e.w)
        AND substr(e.w, p.i, s.k) = repeat(substr(e.w, p.i, 1), s.k)
      GROUP BY e.page_id)
    SELECT u.page_id, len(words) AS word_raw_len,
      len(list_filter(words, lambda w: contains(w, 'www'))) AS nb_www,
      len(list_filter(words, lambda w: contains(w, 'com'))) AS nb_com,
      coalesce(c.n, 0) AS char_repeat,
      {_stats_sql("words", "")}, {_stats_sql("words_host", "_host")}, {_stats_sql("words_path", "_path")}
    FROM urls u LEFT JOIN windows c USING (page_id)""",
)
def url_word_features(t: Tables):
    return decomposed(t).transform(UF.lexical_features)


@query(
    "brand_flags",
    "page_id:i has_domain_in_brand:i has_brand_in_path:i has_brand_in_subdomain:i",
    f"""WITH {PARTS_SQL}, {BRANDS_SQL},
    path_hits AS (SELECT DISTINCT u.page_id FROM urls u, brands b
                  WHERE contains(u.path, '.' || b.brand || '.') AND NOT contains(u.domain, b.brand)),
    sub_hits AS (SELECT DISTINCT u.page_id FROM urls u, brands b
                 WHERE list_contains(string_split(u.subdomain, '.'), b.brand) AND NOT contains(u.domain, b.brand))
    SELECT u.page_id, CASE WHEN b.brand IS NULL THEN 0 ELSE 1 END AS has_domain_in_brand,
           CASE WHEN p.page_id IS NULL THEN 0 ELSE 1 END AS has_brand_in_path,
           CASE WHEN s.page_id IS NULL THEN 0 ELSE 1 END AS has_brand_in_subdomain
    FROM urls u LEFT JOIN brands b ON u.words_host[1] = b.brand
    LEFT JOIN path_hits p USING (page_id) LEFT JOIN sub_hits s USING (page_id)""",
)
def brand_flags(t: Tables):
    return UF.brand_features(decomposed(t), www_brands(t))


@query(
    "brand_flags_by_table",
    "page_id:i has_domain_in_brand:i has_brand_in_path:i has_brand_in_subdomain:i",
    f"""WITH {PARTS_SQL}, {BRANDS_SQL},
    names AS (SELECT brand FROM brands UNION SELECT domain FROM urls WHERE domain IS NOT NULL
              UNION SELECT 'www.' || domain FROM urls),
    path_hits AS (SELECT DISTINCT u.page_id FROM urls u, names b
                  WHERE contains(u.path, '.' || b.brand || '.') AND NOT contains(u.domain, b.brand)),
    sub_hits AS (SELECT DISTINCT u.page_id FROM urls u, names b
                 WHERE list_contains(string_split(u.subdomain, '.'), b.brand) AND NOT contains(u.domain, b.brand))
    SELECT u.page_id, CASE WHEN b.brand IS NULL THEN 0 ELSE 1 END AS has_domain_in_brand,
           CASE WHEN p.page_id IS NULL THEN 0 ELSE 1 END AS has_brand_in_path,
           CASE WHEN s.page_id IS NULL THEN 0 ELSE 1 END AS has_brand_in_subdomain
    FROM urls u LEFT JOIN names b ON u.words_host[1] = b.brand
    LEFT JOIN path_hits p USING (page_id) LEFT JOIN sub_hits s USING (page_id)""",
)
def brand_flags_by_table(t: Tables):
    """The brands and the whole domains, also with a head, as one table."""
    rows = decomposed(t)
    domains = rows.select(F.explode(F.array("domain", F.concat(F.lit("www."), "domain"))).alias("brand"))
    return UF.brand_features_by_table(rows, www_brands(t).unionByName(domains))


@query(
    "brand_lookalikes",
    "word:s n_brands:i",
    f"""WITH {PARTS_SQL}, {BRANDS_SQL}
    SELECT w.word, count(DISTINCT b.brand) AS n_brands
    FROM (SELECT DISTINCT words_host[1] AS word FROM urls) w, brands b
    WHERE levenshtein(w.word, b.brand) < 2 GROUP BY w.word""",
)
def brand_lookalikes(t: Tables):
    return UF.brand_lookalikes(decomposed(t), www_brands(t))


@query(
    "lookalike_flags",
    "page_id:i has_domain_in_brand1:i",
    f"""WITH {PARTS_SQL}, {BRANDS_SQL}
    SELECT page_id, CASE WHEN EXISTS (SELECT 1 FROM brands b WHERE levenshtein(u.words_host[1], b.brand) < 2) THEN 1 ELSE 0 END
      AS has_domain_in_brand1 FROM urls u""",
)
def lookalike_flags(t: Tables):
    return UF.with_lookalike_flag(decomposed(t), www_brands(t))


@query(
    "statistical_report",
    "page_id:i has_statistical_report:i",
    f"""WITH {PARTS_SQL}, {DNS_SQL}
    SELECT u.page_id,
      CASE WHEN d.ip IS NULL THEN 2
           WHEN {" OR ".join(f"contains(u.url, '{h}')" for h in C.REPORTED_HOSTS)} THEN 1
           WHEN {" OR ".join(f"contains(d.ip, '{h}')" for h in C.REPORTED_IPS)} THEN 1
           WHEN d.ip = '125.235.4.59' THEN 2 ELSE 0 END AS has_statistical_report
    FROM urls u LEFT JOIN dns d USING (domain)""",
)
def statistical_report(t: Tables):
    return UF.statistical_report(decomposed(t), dns_snapshot(t))


@query(
    "site_profile",
    "domain:s n_pages:i n_https:i avg_url_len:d max_slashes:i",
    f"""WITH {PARTS_SQL}
    SELECT domain, count(*) AS n_pages, sum(CASE WHEN scheme = 'https' THEN 1 ELSE 0 END) AS n_https,
           avg(length(url)) AS avg_url_len, max(len(string_split(url, '/')) - 1) AS max_slashes
    FROM urls GROUP BY domain""",
)
def site_profile(t: Tables):
    return (
        decomposed(t)
        .groupBy("domain")
        .agg(
            F.count("*").alias("n_pages"),
            F.sum((F.col("scheme") == "https").cast("int")).alias("n_https"),
            F.avg(F.length("url")).alias("avg_url_len"),
            F.max(U.occurrences("url", "/")).alias("max_slashes"),
        )
    )


@query(
    "crawl_candidates",
    "page_id:i requested:s candidate:s redirect_detected:i",
    """WITH asked AS (SELECT page_id, CASE WHEN starts_with(url, 'https') THEN regexp_replace(url, '^https://', '') ELSE url END AS requested FROM pages),
    options AS (
      SELECT page_id, requested, unnest(CASE WHEN regexp_matches(requested, '^https?://') THEN [requested] ELSE ['https://' || requested, 'http://' || requested] END) AS candidate,
             unnest(CASE WHEN regexp_matches(requested, '^https?://') THEN [0] ELSE [0, 1] END) AS pos FROM asked),
    snapshot AS (SELECT url FROM pages WHERE substr(md5(url), 5, 1) >= '4'
      UNION ALL SELECT regexp_replace(url, '^https:', 'http:') FROM pages WHERE starts_with(url, 'https')),
    alive AS (SELECT o.*, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS rn FROM options o JOIN (SELECT DISTINCT url FROM snapshot) p ON o.candidate = p.url)
    SELECT a.page_id, a.requested, v.candidate, CASE WHEN a.requested <> coalesce(v.candidate, '') THEN 1 ELSE 0 END AS redirect_detected
    FROM asked a LEFT JOIN alive v ON a.page_id = v.page_id AND v.rn = 1""",
)
def crawl_candidates(t: Tables):
    """A quarter of the pages is dead; the https pages answer under http as well."""
    from lurescan.operators.page_features import first_alive_candidate, redirect_detected

    asked = t.pages.select("page_id", F.regexp_replace("url", "^https://", "").alias("requested"))
    status = F.when(F.substring(F.md5("url"), 5, 1) >= "4", 1).otherwise(0).alias("is_alive")
    plain = t.pages.filter(F.col("url").startswith("https")).select(
        F.regexp_replace("url", "^https:", "http:").alias("url"), F.lit(1).alias("is_alive"))
    snapshot = t.pages.select("url", status).unionByName(plain)
    found = first_alive_candidate(asked, snapshot, "page_id", "requested")
    return found.withColumn("redirect_detected", redirect_detected(F.col("requested"), F.col("candidate")))


@query(
    "redirect_features",
    "page_id:i nb_redirection:i nb_e_redirection:i",
    f"""WITH {PARTS_SQL},
    first_of AS (SELECT domain, min(url) AS home FROM urls GROUP BY domain),
    hops AS (SELECT u.page_id, u.domain, CASE WHEN u.scheme = 'http' THEN
        ['http://' || u.tld || '/', 'HTTP://' || upper(u.domain) || '/', f.home] END AS chain FROM urls u JOIN first_of f USING (domain))
    SELECT page_id, coalesce(len(chain), -1) AS nb_redirection,
      coalesce(len(list_filter(chain, lambda h: NOT contains(lower(h), lower(domain)))), -1) AS nb_e_redirection FROM hops""",
)
def redirect_features(t: Tables):
    return UF.redirect_features(redirect_chains(t), "chain")


def redirect_chains(t: Tables):
    """The http pages came through the hosting domain, their site and its first page."""
    rows = decomposed(t)
    home = rows.groupBy("domain").agg(F.min("url").alias("home"))
    chain = F.array(
        F.concat(F.lit("http://"), "tld", F.lit("/")),
        F.concat(F.lit("HTTP://"), F.upper("domain"), F.lit("/")),
        F.col("home"),
    )
    return rows.join(home, "domain").withColumn("chain", F.when(F.col("scheme") == "http", chain))
