"""Operators on small fixtures, among them keys that hold most of the rows."""

import math
import random
from collections import Counter

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from lurescan import schemas
from lurescan.functions import constants as C
from lurescan.operators import attributions as L
from lurescan.operators import clean as B
from lurescan.operators import dataset as G
from lurescan.operators import domains as D
from lurescan.operators import evaluate as K
from lurescan.operators import predlog as M
from lurescan.operators import sampling as S
from lurescan.operators import scoring as J
from lurescan.operators import tables
from lurescan.operators import tokens as H


def hot_rows(n=600, seed=1):
    """A third of the rows share one url."""
    rng = random.Random(seed)
    return [
        (i, "http://hot/ " if rng.random() < 0.4 else f"http://u{rng.randint(0, 150)}/", str(i % 2))
        for i in range(n)
    ]


def test_dedup_and_report_partition_the_rows(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "row_idx long, url string, label string").repartition(7)
    first = {}
    for i, u, _ in rows:
        first.setdefault(u.strip(), i)
    kept = {r["row_idx"] for r in B.dedup_by_url(df).collect()}
    dropped = {r["row_idx"] for r in B.duplicate_report(df).collect()}
    assert kept == set(first.values())
    assert kept | dropped == {r[0] for r in rows} and not kept & dropped


def test_merge_keeps_one_label_if_all_agree(spark):
    a = spark.createDataFrame([(" u1", 1, 5), ("u2", 0, 6), ("u2", 0, 7)], "url string, label int, x int")
    b = spark.createDataFrame([("u1", 1, 8), ("u2 ", 0, 9)], "url string, label int, x int")
    merged = B.merge_on_url(a, b)
    assert merged.columns == ["url", "x_first", "x_second", "label"]
    assert merged.count() == 3
    c = b.withColumn("label", 1 - F.col("label"))
    assert B.merge_on_url(a, c).columns[-2:] == ["label_first", "label_second"]


def test_keep_and_drop_unknown_columns(spark):
    df = spark.createDataFrame([(1, None)], "a int, b double")
    assert B.keep_cols(df, ["zz"]).columns == ["a", "b"]
    assert B.keep_cols(df, ["b", "zz", "a"]).columns == ["b", "a"]
    assert B.drop_cols(df, ["zz"]).columns == ["a", "b"]
    assert B.drop_missing_cols(df).columns == ["a"]
    with pytest.raises(ValueError):
        B.clean_pipeline(df, [("nope",)])


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(spark, descending):
    rng = random.Random(5)
    rows = [(x / 100, rng.randint(0, 9)) for x in rng.sample(range(-5000, 5000), 900)]
    df = spark.createDataFrame(rows, "x double, v long")
    expected, total = {}, 0
    for x, v in sorted(rows, reverse=descending):
        total += v
        expected[x] = total
    for rows_per_task in (7, 100, 10_000):
        found = tables.running_totals(df, "x", {"t": "v"}, descending, rows_per_task)
        assert {r["x"]: r["t"] for r in found.collect()} == expected
    one = tables.running_totals(df.limit(1), "x", {"t": "v"}, descending)
    assert one.first()["t"] == df.limit(1).first()["v"]
    assert tables.running_totals(df.limit(0), "x", {"t": "v"}).count() == 0


def test_row_numbers_of_large_values_and_null(spark):
    values = [None, -(2**60), 2**60, 2**60 + 1, 2**60 + 2, 5, 7]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    found = {r["x"]: r["row_idx"] for r in tables.with_row_number(df, "x").collect()}
    assert found == {None: 0, -(2**60): 1, 5: 2, 7: 3, 2**60: 4, 2**60 + 1: 5, 2**60 + 2: 6}


def test_attach_treats_null_as_a_group(spark):
    big = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, x string")
    small = spark.createDataFrame([(1, 10), (None, 20)], "k int, v int")
    rows = {r["x"]: r["v"] for r in tables.attach(big, small, ["k"]).collect()}
    assert rows == {"a": 10, "b": 20, "c": None}
    assert tables.attach(big, small, ["k"], "inner").count() == 2


@pytest.mark.parametrize("how", ["left", "inner", "left_anti"])
@pytest.mark.parametrize("rows_per_task", [10, 1_000_000])
def test_hot_keys_join_like_the_others(spark, how, rows_per_task):
    rows = [(i, "hot" if i % 3 else f"k{i % 40}", {"m": i}) for i in range(600)] + [(600, None, None)]
    big = spark.createDataFrame(rows, "i int, k string, m map<string,int>")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3), (None, 4)], "k string, v int")
    columns = ["i", "k"] + (["v"] if how != "left_anti" else [])
    expected = big.join(small, "k", how).select(columns)
    found = tables.join_split_hot(big, small, "k", how, rows_per_task=rows_per_task).select(columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, expected.collect()))


def test_half_the_keys_null_or_hot_fill_no_single_task(spark):
    """The largest shuffle partition of the big side stays near the mean, without adaptive execution."""
    big = spark.range(40_000).select(
        "id", F.when(F.col("id") % 2 == 0, None).when(F.col("id") % 4 == 1, F.lit("hot")).otherwise(
            F.concat(F.lit("k"), F.col("id").cast("string"))).alias("k"))
    small = spark.createDataFrame([("hot", 1)], "k string, v int")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        joined = tables.join_split_hot(big, small.hint("merge"), "k", rows_per_task=500)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == 40_000 and len(sizes) == 8 and max(sizes) < 1.5 * 40_000 / 8


def test_join_condition(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 40}") for i in range(600)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("k3", 2), ("k9", 3)], "k string, v int")
    expected = big.join(small, "k").select("i", "k", "v")
    some = tables.join_split_hot(big, small, "k", "inner", F.col("i") > 300)
    assert some.count() == expected.filter("v is not null and i > 300").count()


def test_null_class_and_repeated_keys_in_samples(spark):
    rows = [(k, x, None if k % 3 == 0 else k % 3) for k in range(60) for x in (1, 2)]
    df = spark.createDataFrame(rows, "id int, x int, label int")
    assert S.sample_exactly(df, "id", 7).count() == 7
    split = {(r["label"], r["split"]): r["count"] for r in S.stratified_split(df, "id").groupBy("label", "split").count().collect()}
    assert split == {(c, s): n for c in (None, 1, 2) for s, n in (("test", 8), ("train", 32))}
    assert {r["count"] for r in S.sample_per_class(df, "id", 5).groupBy("label").count().collect()} == {5}


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("label"))
    split = S.stratified_split(df, "k").groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in split} == {
        (0, "test"): 180, (0, "train"): 720, (1, "test"): 20, (1, "train"): 80,
    }
    first = S.sample_per_class(df, "k", 30)
    second = S.second_sample(df, first, "k", 40)
    assert first.join(second, "k").count() == 0
    assert second.groupBy("label").count().filter("count = 40").count() == 2
    assert S.sample_up_to(df, "k", 500).count() == 600
    assert S.sample_exactly(df, "k", 5000).count() == 1000
    assert sorted(r["k"] for r in S.shuffled(df, "k").collect()) == list(range(1000))
    with pytest.raises(SparkRuntimeException):
        S.sample_per_class(df, "k", 101).count()


def test_row_range_checks_bounds(spark):
    df = spark.range(50).select((F.col("id") * 3).alias("k"))
    rows = S.row_range(df, "k", 10, 20).collect()
    assert sorted((r["row_idx"], r["k"]) for r in rows) == [(i, 3 * i) for i in range(10, 20)]
    for start, end in [(-1, 5), (5, 5), (0, 51)]:
        with pytest.raises(ValueError):
            S.row_range(df, "k", start, end)


def test_curve_areas(spark):
    df = spark.createDataFrame(
        [(1, 0.9, 1), (0, 0.8, 1), (1, 0.8, 1), (0, 0.1, 0)], "label int, score double, pred int"
    )
    row = K.areas(df).first()
    assert math.isclose(row["average_precision"], 0.8333333, abs_tol=1e-6)
    assert math.isclose(row["pr_auc"], 0.9166667, abs_tol=1e-6)
    assert math.isclose(row["roc_auc"], 0.875)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(1, 0.5)] * 3 + [(0, 0.1), (0, 0.2)], "label int, score double")
    rows = K.score_histogram(df, 10).collect()
    assert sum(r["n"] for r in rows) == 5 and len(rows) == 20
    assert [r["bin"] for r in rows if r["label"] == 1 and r["n"]] == [5]


def test_token_vectors_ignore_unknown(spark):
    df = spark.createDataFrame(
        [(1, ["a", "zzz"]), (2, ["zzz"]), (3, []), (4, ["a", "b", "b"])], "k int, tokens array<string>"
    )
    vectors = spark.createDataFrame([("a", [1.0, 4.0]), ("b", [4.0, 1.0])], "token string, vector array<double>")
    rows = H.url_vectors(df, vectors, "k", size=2).collect()
    assert {r["k"]: r["vector"] for r in rows} == {1: [1.0, 4.0], 2: [0.0, 0.0], 3: [0.0, 0.0], 4: [3.0, 2.0]}


def test_char_sequences_of_repeated_keys_and_sparse_ids(spark):
    urls = ["http://A.b/c d", "x" * 250, "", "http://éé/?#", "x" * 250]
    df = spark.createDataFrame([(k % 2, u) for k, u in enumerate(urls)], "k int, url string")
    vocabulary = H.char_vocabulary(df).filter("char != '#'").withColumn("id", F.col("id") * 3)
    ids = {r["char"]: r["id"] for r in vocabulary.collect()}
    for r in H.char_sequences(df, vocabulary).collect():
        known = [ids[c] for c in r["url"].lower().replace(" ", "") if c in ids]
        assert r["sequence"] == (known + [0] * 200)[:200]


def test_url_tokens_may_be_empty(spark):
    df = spark.createDataFrame([("HTTPS://www.A-b.com/x//é?p=1&q",)], "url string")
    full, served = df.select(H.url_tokens(F.col("url")), H.url_tokens(F.col("url"), False)).first()
    assert full == ["https", "www", "a-b", "com", "x", "", "p=1", "q"]
    assert served == full[1:]


def test_domain_rules(spark):
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    registry = spark.sql(
        """SELECT * FROM VALUES
        ('a.com', array('A.COM'), array(timestamp'2024-01-01 12:00:00', timestamp'2024-02-01'), array(timestamp'2024-01-01'), 'ok'),
        ('b.com', array('OTHER'), array(), array(), 'ok'),
        ('c.com', array(), array(timestamp'2025-01-01'), array(timestamp'2024-01-05 06:00:00'), 'ok'),
        ('d.com', array('d'), array(timestamp'2020-01-01'), array(timestamp'2030-01-01'), 'timeout')
        AS t(domain, domain_names, creation_dates, expiration_dates, lookup_status)"""
    )
    df = spark.createDataFrame([(d,) for d in ["a.com", "b.com", "c.com", "d.com", "e.com"]], "domain string")
    nothing = spark.createDataFrame([], "domain string, ns_count int, rank int, url string, status string")
    sites = df.withColumn("url", F.col("domain"))
    rows = D.domain_features(sites, registry, nothing, nothing, nothing, as_of).collect()
    found = {r["domain"][0]: (r["whois_reg_domain"], r["domain_reg_len"], r["domain_age"]) for r in rows}
    assert found == {"a": (0, 0, 0), "b": (1, 0, -2), "c": (1, 3, -2), "d": (0, 0, 0), "e": (1, -1, -1)}


def test_dataset_has_140_columns_and_splits_off_skipped(spark):
    urls = spark.createDataFrame(
        [(0, "http://a.com/x", 1), (1, "http://b.com/", 0), (2, "", 0)], "row_idx long, url string, label int"
    )
    page = {c: 0 for c in C.PAGE_FEATURE_COLUMNS} | {"is_alive": 1, "nb_divs": 4}
    pages = spark.createDataFrame([("http://a.com/x", *page.values())], ["url", *page])
    empty = {n: spark.createDataFrame([], getattr(schemas, n)) for n in ("DNS_SNAPSHOT", "DOMAIN_REGISTRY", "DNS_NS", "INDEX_STATUS", "DOMAIN_RANK")}
    data = G.build_dataset(
        urls, pages, ["paypal"], empty["DNS_SNAPSHOT"], empty["DOMAIN_REGISTRY"], empty["DNS_NS"],
        empty["INDEX_STATUS"], empty["DOMAIN_RANK"], F.current_timestamp(),
    )
    usable = G.usable_rows(data).drop("row_idx")
    assert len(usable.columns) == 140 and usable.first()["nb_divs"] == 4
    skipped = {r["global_idx"]: r["reason"] for r in G.skipped_rows(data).collect()}
    assert skipped == {1: "crawler_not_alive", 2: "exception_init_or_extract: list index out of range"}


def test_crawled_url(spark):
    df = spark.createDataFrame([("a", "b", 1), ("a", "b", 0), ("a", None, 1)], "url string, final_url string, is_alive int")
    assert [r["u"] for r in df.select(G.crawled_url().alias("u")).collect()] == ["b", "a", "a"]


def test_dataset_pages(spark):
    """A repeated page gives one row; NULL of a live page stays, a dead page and no page have defaults."""
    features = ", ".join(f"CAST({2 if c != 'is_alive' else 1} AS DOUBLE) AS {c}" for c in C.PAGE_FEATURE_COLUMNS)
    page = spark.sql(f"SELECT 'http://a.com/x' AS url, {features}").withColumn(
        "punctuation_density", F.lit(None).cast("double"))
    moved = F.lit("http://b.org/y")
    pages = page.withColumn("final_url", moved).unionByName(page.withColumn("is_alive", F.lit(0.0)).withColumn("final_url", moved))
    pages = pages.unionByName(page.withColumns({"url": F.lit("http://d.com/"), "is_alive": F.lit(0.0), "final_url": moved}))
    urls = spark.createDataFrame([("http://a.com/x", 1), ("http://a.com/x", 0), ("http://c.com/", 1), ("http://d.com/", 0)], "url string, label int")
    empty = spark.createDataFrame([], "domain string, ns_count int, rank int, ip string, url string, status string, "
                                  "domain_names array<string>, creation_dates array<timestamp>, expiration_dates array<timestamp>")
    index = spark.createDataFrame([("http://b.org/y", "indexed"), ("http://c.com/", "blocked")], "url string, status string")
    ranks = spark.createDataFrame([("b.org", 7)], "domain string, rank int")
    rows = G.build_dataset(urls, pages, ["b"], empty, empty, empty, index, ranks, F.current_timestamp()).collect()
    got = sorted((r["url"], r["label"], r["nb_divs"], r["punctuation_density"], r["google_index"], r["page_rank"], r["reason"]) for r in rows)
    assert got == [
        ("http://b.org/y", 0, 2, None, 0, 7, None), ("http://b.org/y", 1, 2, None, 0, 7, None),
        ("http://c.com/", 1, 0, 0, -1, -1, G.NOT_ALIVE), ("http://d.com/", 0, 0, 0, 1, -1, G.NOT_ALIVE),
    ]


def test_word_vectors_know_their_neighbours(spark):
    """Tokens that share their contexts lie closer than others; unknown rows are zero."""
    rows = [(i, ["login", "verify", "a" if i % 2 else "b", "account", "secure"] if i % 4 < 2 else ["blog", "post", "c" if i % 8 < 4 else "d", "news", "read"]) for i in range(600)]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    model = H.word2vec_fit(df)
    found = {r["token"]: r["vector"] for r in H.vectors_of(model).collect()}
    assert set(found) == {t for _, ts in rows for t in ts} and all(len(v) == 50 for v in found.values())

    def near(x, y):
        dot = sum(p * q for p, q in zip(found[x], found[y]))
        return dot / (sum(p * p for p in found[x]) * sum(q * q for q in found[y])) ** 0.5

    assert near("a", "b") > near("a", "c") and near("c", "d") > near("b", "d")
    zero = H.url_vectors(spark.createDataFrame([(1, ["zzz"])], "k int, tokens array<string>"), H.vectors_of(model), "k")
    assert zero.first()["vector"] == [0.0] * 50
    assert H.word2vec_fit(df, min_count=200).getVectors().count() < len(found)


def test_answers_and_argmax(spark):
    df = spark.createDataFrame([("Phishing.",), ("benign",), ("maybe",), (" BEN?",)], "a string")
    rows = df.select(*J.answer_pred(F.col("a"))).collect()
    assert [tuple(r) for r in rows] == [(0, 0.95), (1, 0.95), (0, 0.0), (1, 0.95)]
    logits = spark.createDataFrame([([0.0, 0.0],), ([1000.0, 1001.0],)], "l array<double>")
    rows = logits.select(*J.argmax_pred(F.col("l"))).collect()
    assert rows[0][0] == 0 and rows[0][1] == 0.5
    assert rows[1][0] == 1 and math.isclose(rows[1][1], 1 / (1 + math.exp(-1)))


def test_models_learn_and_survive_saving(spark, tmp_path):
    rng = random.Random(2)
    rows = [(float(i % 2), [rng.gauss(2 * (i % 2), 0.5), rng.random()]) for i in range(300)]
    df = spark.createDataFrame(rows, "label double, vector array<double>")
    weighted = S.with_class_weight(df)
    for fit in (J.fit_random_forest, J.fit_boosted_trees, J.fit_linear_margin):
        model = fit(weighted, weight="weight")
        scored = J.score_with(model, df)
        assert scored.filter("pred = label").count() > 280
    model = J.fit_random_forest(df)
    J.save_model(model, str(tmp_path / "m"))
    again = J.score_with(J.load_model(str(tmp_path / "m")), df).select("proba").collect()
    assert again == J.score_with(model, df).select("proba").collect()
    top = K.top_importances(J.feature_importances(model, df, ["x", "noise"]), 1).first()
    assert top["feature"] == "x"


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        J.score_models(spark.range(1), {}, ["x"])


def test_attribution_rules(spark):
    rng = random.Random(4)
    rows = [
        (s, p, rng.choice(["a", "b ", "[CLS]", "", "c"]), c, rng.uniform(-0.1, 0.1))
        for s in (1, 2) for p in range(2500 if s == 1 else 12) for c in (0, 1)
    ]
    df = spark.createDataFrame(rows, schemas.ATTRIBUTIONS)
    expected, total = {}, Counter()
    for s, p, _, c, v in sorted(rows):
        if c == 1:
            total[s] += v
            expected[s, p] = total[s]
    found = L.cumulative_values(df).collect()
    assert all(math.isclose(r["cumulative"], expected[r["sample_id"], r["pos"]], abs_tol=1e-9) for r in found)
    assert len(found) == len(expected) and sum(r["is_top"] for r in found) == 20
    bases = spark.createDataFrame([(1, 1, float("nan")), (2, 1, 0.25)], schemas.BASES)
    path = L.decision_path(df, L.repaired_bases(bases), 20).collect()
    top = {r["sample_id"]: r["path"] for r in path if r["rank"] == 1}
    assert math.isclose(top[1], 0.5 + total[1], abs_tol=1e-9)
    assert math.isclose(top[2], 0.25 + total[2], abs_tol=1e-9)
    wide = L.token_matrix_wide(df, ["a", "b", "zz"]).orderBy("sample_id").collect()
    assert wide[0].asDict().keys() == {"sample_id", "a", "b", "zz"} and wide[0]["zz"] == 0.0
    narrow = {(r["sample_id"], r["token"]): r["value"] for r in L.token_matrix(df, 3).collect()}
    assert math.isclose(narrow[1, "b"], wide[0]["b"], abs_tol=1e-9)
    ordered = L.sorted_token_table(df).filter("sample_id = 2").collect()
    assert [r["abs_value"] for r in ordered] == sorted((r["abs_value"] for r in ordered), reverse=True)


DAY = 86_400_000_000


def test_schedule_counts_from_creation(spark):
    visits = spark.createDataFrame(
        [("k", i, d * DAY) for i, d in enumerate([0, 19, 31, 40])], "doc_id string, request_id long, ts_us long"
    )
    found = M.scoring_schedule(visits).collect()
    assert sorted(r["ts_us"] // DAY for r in found) == [0, 31]


def test_schedule_equals_one_pass_per_key(spark):
    rng = random.Random(9)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", i, rng.randint(0, 200) * DAY // 2) for i in range(900)]
    visits = spark.createDataFrame(rows, "doc_id string, request_id long, ts_us long")
    expected, last = set(), {}
    for key, request, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        if key not in last or ts > last[key] + 30 * DAY:
            last[key] = ts
            expected.add((key, ts, request))
    found = {(r["doc_id"], r["ts_us"], r["request_id"]) for r in M.scoring_schedule(visits).collect()}
    assert found == expected


def test_live_rows_keep_the_exact_age(spark):
    log = spark.createDataFrame([("a", 0), ("b", -1_000_000)], "doc_id string, created_us long")
    assert [r["doc_id"] for r in M.live_rows(log, F.lit(30 * DAY)).collect()] == ["a"]


def test_pages_of_an_empty_log(spark):
    log = spark.createDataFrame([], "doc_id string, created_us long, pred int, model string")
    assert M.page_count(log).first()["pages"] == 1
    assert tuple(M.verdict_totals(log).first()) == (0, 0)
    assert M.list_logs(log, 0).count() == 0
