"""Suffix rules as a table against the rules inside the plan."""

import random

import pytest
from pyspark.sql import functions as F

from lurescan.functions import url as U
from lurescan.sources import files

SITE = ["url", "subdomain", "domain", "tld"]


def sites(df, run, rules):
    by_table = run is U.with_registered_domain_by_table
    given = {"rules" if by_table else "suffix_rules": rules}
    found = run(U.with_url_parts(df), url="url", **given).select(*SITE).collect()
    return sorted((tuple(r) for r in found), key=repr)


def random_urls(seed, labels, n=400):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        host = ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5)))
        if rng.random() < 0.1:
            host = rng.choice(["10.0.0.1", "[::1]", "", "a..b", ".co", "user@x.ck:80", "X.CO.UK.", "localhost"])
        out.append((rng.choice(["http://", "https://", "//", ""]) + host + rng.choice(["", "/", "/p?q#f", ":8080/x"]),))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_the_rules_in_the_plan(spark, seed):
    rng = random.Random(seed)
    labels = ["a", "b", "co", "uk", "ck", "www", "Com"]
    names = {".".join(rng.choice(labels).lower() for _ in range(rng.randint(1, 3))) for _ in range(14)}
    rules = [rng.choice(["", "", "*.", "!"]) + n for n in sorted(names)]
    df = spark.createDataFrame(random_urls(seed, labels) + [(None,), ("http://a.b.co.uk",)] * 3, "url string")
    table = spark.createDataFrame([(r,) for r in rules + rules[:3] + [""]], "rule string")
    assert sites(df, U.with_registered_domain_by_table, table) == sites(df, U.with_registered_domain, rules)


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([("http://a.b/",)], "url string")
    none = spark.createDataFrame([], "rule string")
    assert sites(df, U.with_registered_domain_by_table, none) == sites(df, U.with_registered_domain, [])
    assert sites(df.limit(0), U.with_registered_domain_by_table, none) == []


def test_a_list_of_200_000_rules(spark, tmp_path):
    (tmp_path / "rules.txt").write_text("// list\n" + "\n".join(f"s{i}.t{i % 1000}" for i in range(200_000)) + "\ncom\n*.ck\n!www.ck\n")
    rules = files.read_suffix_table(spark, str(tmp_path / "rules.txt"))
    assert rules.count() == 200_003
    df = spark.range(2000).select(F.concat(F.lit("http://x.y.s"), "id", F.lit(".t"), F.col("id") % 1000, F.lit("/")).alias("url"))
    found = U.with_registered_domain_by_table(U.with_url_parts(df), rules, "url")
    want = F.concat(F.lit("y.s"), "id", F.lit(".t"), F.col("id") % 1000)
    ids = F.regexp_extract("url", r"s(\d+)", 1).cast("long")
    assert found.withColumn("id", ids).filter(F.col("domain") != want).count() == 0
    with pytest.raises(ValueError, match="more than"):
        files.read_suffix_rules(spark, str(tmp_path / "rules.txt"))
