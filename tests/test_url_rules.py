"""Edge rows of the URL rules."""

import math
import random
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from lurescan.functions import constants as C
from lurescan.functions import url as U
from lurescan.operators import url_features as UF

EDGES = [
    ("http://192.168.1.1/", "has_ip", 0),
    ("http://192.168.1.1/", "has_ipv4_host", 1),
    ("http://a.com/deadbeef", "has_ip", 1),
    ("http://a.com/1234567", "has_ip", 1),
    ("localhost/x", "nb_subdomain", 3),
    ("http://a.com/", "nb_subdomain", 1),
    ("https://a.com/", "has_https", 0),
    ("http://a.com/", "has_https", 1),
    ("https://xn--a.com/", "has_punnycode", 0),
    ("http://xn--a.com/", "has_punnycode", 1),
    ("http://localhost/x", "has_tld_in_path", 1),
    ("http://localhost/x", "has_tld_in_subdomain", 1),
    ("http://a.com//b", "nb_dslash", 1),
    ("http://a.com/b", "nb_dslash", 0),
    ("http://target.com/", "has_short_svc", 1),
    ("http://aaab.com/", "char_repeat", 3),
    ("http://a.com/a;b/c;d", "path", "/a;b/c"),
    ("http://[::1]:8/a", "hostname", "::1"),
    ("http://User:pw@Host.com:80/a", "hostname", "host.com"),
    ("http://a.com/x?y=z", "words", ["a", "com", "x"]),
    ("http://a.com:8080/", "has_port", 1),
    ("http://a.com/", "has_port", 0),
    ("http://a.com/x%20y z", "nb_space", 2),
    ("http://a.com/~u~", "nb_tilde", 1),
    ("http://a.com/Login/WP/x.js", "nb_phish_hints", 3),
    ("http://a.com/http://b?u=https://c", "nb_http_token", 2),
    ("http://a-b.com/", "has_prefix_suffix", 1),
    ("http://ww1.a.com/", "has_abnormal_subdomain", 1),
    ("http://a.com/b.txt", "has_path_txt_extension", 1),
    ("http://a.com/b.exe", "has_path_exe_extension", 1),
    ("http://a.xyz/", "has_sus_tld", 1),
    ("http://x.y.co.uk/", "domain", "y.co.uk"),
    ("http://x.y.co.uk/", "subdomain", "x"),
    ("http://co.uk/", "domain", "co.uk"),
    ("http://10.0.0.1/", "domain", "10.0.0.1"),
    ("http://WWW.Bank.com/", "hostname", "www.bank.com"),
    ("HTTP://a.com/", "scheme", "http"),
    ("http://a b.com/x", "netloc", "a b.com"),
    ("http://[a.com/x", "path", ""),
    ("", "skip_reason", "exception_init_or_extract: list index out of range"),
    ("http://a.com/", "skip_reason", None),
]


@pytest.fixture(scope="module")
def features(spark):
    urls = sorted({u for u, _, _ in EDGES})
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    rows = UF.lexical_features(UF.decompose(df)).collect()
    return {r["url"]: r for r in rows}


@pytest.mark.parametrize("url,column,expected", EDGES)
def test_edge(features, url, column, expected):
    assert features[url][column] == expected


def test_entropy(spark):
    df = spark.createDataFrame([("aab",), ("",), ("aaaa",)], "t string")
    values = [r[0] for r in df.select(U.entropy(F.col("t"))).collect()]
    assert math.isclose(values[0], -0.9182958, abs_tol=1e-6)
    assert values[1:] == [0.0, 0.0]


def test_split_equals_python(spark):
    rng = random.Random(7)
    pieces = ["a", "B.c", "/", "//", "?", "#", ":", "x=1", ";p", "@", "80", "é", "%20", "-"]
    urls = []
    for _ in range(400):
        urls.append("http://h.com" + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 8))))
        urls.append("".join(rng.choice(pieces) for _ in range(rng.randint(1, 8))))
    df = spark.createDataFrame([(u,) for u in set(urls)], "url string")
    for row in U.with_url_parts(df).collect():
        expected = urlsplit(row["url"])
        assert row["scheme"] == expected.scheme, row
        assert row["netloc"] == expected.netloc, row
        assert row["query"] == expected.query, row
        assert row["fragment"] == expected.fragment, row
        assert row["hostname"] == (expected.hostname or ""), row


def test_suffix_rules_with_wildcard_and_exception(spark):
    rules = ["com", "*.ck", "!www.ck"]
    df = spark.createDataFrame(
        [("http://a.b.ck/",), ("http://x.a.b.ck/",), ("http://www.ck/",), ("http://z.unknown/",)],
        "url string",
    )
    rows = U.with_registered_domain(U.with_url_parts(df), "url", rules).collect()
    found = {r["url"]: (r["subdomain"], r["domain"], r["tld"]) for r in rows}
    assert found["http://a.b.ck/"] == ("", "a.b.ck", "b.ck")
    assert found["http://x.a.b.ck/"] == ("x", "a.b.ck", "b.ck")
    assert found["http://www.ck/"] == ("", "www.ck", "ck")
    assert found["http://z.unknown/"] == ("z", "unknown", "")


BRAND_URLS = [
    "http://paypal.com/", "http://evil.com/a.paypal.b", "http://evil.com/paypal.b",
    "http://paypal.evil.com/", "http://paypal-login.com/x.paypal.y", "http://evil.com/q.co.op.z",
    "http://evil.com/..", "http://apple.com/z.apple.z", "http://x.y.apple.evil.com/p",
]


def test_brands(spark, monkeypatch):
    df = UF.decompose(spark.createDataFrame([(u,) for u in BRAND_URLS], "url string"))
    names = ["paypal", "apple", "co.op"]
    brands = spark.createDataFrame([(n,) for n in names], "brand string")
    columns = ["url", "has_domain_in_brand", "has_brand_in_path", "has_brand_in_subdomain"]

    def result(source):
        return sorted(tuple(r) for r in UF.brand_features(df, source).select(*columns).collect())

    expected = []
    for r in df.collect():
        path, domain, parts = r["path"], r["domain"], r["subdomain"].split(".")
        expected.append(
            (
                r["url"],
                int(r["words_host"][0] in names),
                int(any(f".{b}." in path and b not in domain for b in names)),
                int(any(b in parts and b not in domain for b in names)),
            )
        )
    assert result(names) == sorted(expected)
    assert result(brands) == sorted(expected)
    monkeypatch.setattr(UF, "MOST_BRANDS", 2)
    with pytest.raises(ValueError):
        result(brands)


def test_lookalikes_equal_brute_force(spark):
    rng = random.Random(3)
    words = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(150)}
    brands = ["abc", "aab", "b", "cabb", "aaaaa"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    expected = {
        w: sum(distance(w, b) < 2 for b in brands) for w in words if any(distance(w, b) < 2 for b in brands)
    }
    df = spark.createDataFrame([([w],) for w in words], "words_host array<string>")
    found = UF.brand_lookalikes(df, spark.createDataFrame([(b,) for b in brands], "brand string"))
    assert {r["word"]: r["n_brands"] for r in found.collect()} == expected


def test_statistical_report(spark):
    df = spark.createDataFrame(
        [("http://x.at.ua/", "a"), ("http://b/", "b"), ("http://c/", "c"), ("http://d/", "d"), ("http://e/", "e")],
        "url string, domain string",
    )
    dns = spark.createDataFrame(
        [("a", "1.1.1.1"), ("b", "10.10.10.10"), ("c", C.UNRESOLVED_SENTINEL_IP), ("d", "1.1.1.1")],
        "domain string, ip string",
    )
    rows = UF.statistical_report(df, dns).collect()
    assert {r["domain"]: r["has_statistical_report"] for r in rows} == {
        "a": 1, "b": 1, "c": 2, "d": 0, "e": 2,
    }


def test_redirects(spark):
    df = spark.createDataFrame(
        [("a.com", ["http://a.com/1", "http://b.com/"]), ("a.com", None)],
        "domain string, chain array<string>",
    )
    rows = UF.redirect_features(df, "chain").collect()
    assert [(r["nb_redirection"], r["nb_e_redirection"]) for r in rows] == [(2, 1), (-1, -1)]


def test_scan_target_and_key(spark):
    df = spark.createDataFrame([(" http://A.com/x ", "domain"), ("x", "full")], "u string, m string")
    rows = df.select(U.scan_target(F.col("u"), F.col("m")).alias("t")).collect()
    assert [r["t"] for r in rows] == ["http://A.com", "x"]
