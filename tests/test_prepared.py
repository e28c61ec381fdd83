"""Brands as a table, and snapshots stored in buckets."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from lurescan.operators import domains as D
from lurescan.operators import tables as T
from lurescan.operators import url_features as UF

FLAGS = ["has_domain_in_brand", "has_brand_in_path", "has_brand_in_subdomain"]


def flags(df, run, brands):
    rows = run(df, brands).select("url", "path", "domain", "subdomain", *FLAGS).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def random_urls(spark, seed, n=500):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "ab", "shop", "bank", ""])
    path = lambda: ".".join(word() for _ in range(rng.randint(1, 6)))
    rows = [(f"http://{'.'.join(word() or 'x' for _ in range(rng.randint(0, 3)))}.{word() or 'y'}.com/{path()}",) for _ in range(n)]
    return UF.decompose(spark.createDataFrame(rows + rows[:20] + [(None,), ("",), ("http://",)], "url string"))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_brand_table_equals_the_brands_in_the_plan(spark, seed):
    rng = random.Random(seed)
    df = random_urls(spark, seed)
    parts = ["a", "b", "ab", "shop", "bank", ""]
    names = {".".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(9)} | {"shop"}
    table = spark.createDataFrame([(n,) for n in [*names, "shop", None]], "brand string")
    got = flags(df, UF.brand_features_by_table, table)
    assert got == flags(df, UF.brand_features, sorted(names))
    assert any(r[-2] for r in got)
    assert flags(df, UF.brand_features_by_table, table.limit(0)) == flags(df, UF.brand_features, [])


def test_three_hundred_thousand_brands(spark):
    df = random_urls(spark, 4)
    noise = spark.range(300_000).select(F.concat(F.lit("z"), F.col("id").cast("string"), F.lit(".q")).alias("brand"))
    brands = spark.createDataFrame([("shop",), ("a.b",)], "brand string")
    with pytest.raises(ValueError):
        UF.brand_features(df, noise)
    assert flags(df, UF.brand_features_by_table, noise.unionByName(brands)) == flags(df, UF.brand_features, ["a.b", "shop"])


def test_a_hot_segment_and_clashing_columns(spark):
    rows = [(f"http://h{i}.com/x.shop.y{i}", i, "kind") for i in range(200)]
    df = UF.decompose(spark.createDataFrame(rows, "url string, piece int, kind string"))
    brands = spark.createDataFrame([("shop",)], "url string")
    got = UF.brand_features_by_table(df, brands)
    assert {c for c in got.columns} == {*df.columns, *FLAGS}
    assert got.agg(F.sum("has_brand_in_path"), F.sum("piece")).first() == (200, sum(range(200)))


@pytest.fixture()
def bucketed(spark, tmp_path):
    rows = [(f"d{i}", i, [f"n{i}"]) for i in range(50)] + [(None, -1, None)]
    name = f"known_{uuid.uuid4().hex}"
    yield T.write_bucketed(spark.createDataFrame(rows, "domain string, v int, names array<string>"), "domain", name,
                           str(tmp_path / name), 4)
    spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("per_task", [5, 1_000_000])
def test_bucketed_join_equals_a_left_join(spark, bucketed, per_task):
    rows = [(f"d{i % 70}", i) for i in range(300)] + [("d3", i) for i in range(300, 900)] + [(None, 1), (None, 1), ("", 2)]
    big = spark.createDataFrame(rows, "domain string, n int")
    got = T.join_bucketed(big, bucketed, "domain", T.hot_keys(big, "domain", per_task))
    want = big.join(bucketed, "domain", "left").select(got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() == len(rows)


def test_the_stored_snapshot_is_not_shuffled(spark, bucketed):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        big = spark.createDataFrame([("d1", 1)], "domain string, n int")
        plan = T.join_bucketed(big, bucketed, "domain")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    lines = plan.splitlines()
    indent = [len(line) - len(line.lstrip(" :+-")) for line in lines]
    scans = [k for k, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line]
    assert scans and "SortMergeJoin" in plan
    for k in scans:  # from the scan up to its join
        while "Join" not in lines[k]:
            assert "Exchange" not in lines[k]
            k = max(j for j in range(k) if indent[j] < indent[k])


def test_one_record_of_a_domain_is_taken_whole(spark):
    empty = "domain string, ns_count int, lookup_status string"
    registry = spark.sql(
        "SELECT 'a' AS domain, array('x') AS domain_names, array(TIMESTAMP'2020-01-01') AS creation_dates, "
        "CAST(NULL AS array<timestamp>) AS expiration_dates UNION ALL SELECT 'a', CAST(NULL AS array<string>), "
        "CAST(NULL AS array<timestamp>), array(TIMESTAMP'2030-01-01')")
    ranks = spark.createDataFrame([("a", 1, "ok"), ("a", None, "timeout"), ("b", 7, "ok")], "domain string, rank int, lookup_status string")
    known = {r.domain: r for r in D.domain_table(registry, spark.createDataFrame([], empty), ranks).collect()}
    a, b = known["a"], known["b"]
    assert (a._names is None) == (a._created is None) != (a._expires is None)
    assert (a._rank, a._rank_status) in [(1, "ok"), (None, "timeout")]
    assert b._rank == 7 and b._known is None and b._servers is None
