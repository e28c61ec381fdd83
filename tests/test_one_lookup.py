"""One lookup for answers and new rows, and one aggregate for the labels of a merge."""

import itertools

from pyspark.sql import functions as F

from lurescan.operators import clean
from lurescan.operators import predlog as M
from lurescan.plans import serving_queries as Q
from lurescan.plans.registry import Tables


def same_rows(a, b):
    return sorted(map(repr, a.select(sorted(a.columns)).collect())) == sorted(map(repr, b.select(sorted(b.columns)).collect()))


def test_one_lookup_equals_two(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    log, requests = Q.existing_log(t), Q.new_requests(t)
    bad = requests.limit(3).withColumn("error", F.lit("no url"))
    requests = requests.unionByName(bad).cache()

    def scorer(rows):  # some scorings fail
        scored = Q.hash_scorer(rows)
        return scored.withColumn("proba", F.when(F.col("proba") > 0.3, F.col("proba")))

    answers, rows = M.answered_requests(requests, log, scorer, Q.cutoff(), Q.TTL)
    new_rows = M.rows_to_score(requests, log, scorer, Q.cutoff(), Q.TTL)
    assert same_rows(rows, new_rows)
    assert same_rows(answers, M.responses(requests, log, new_rows, Q.cutoff(), Q.TTL))
    kinds = {(r.cached, r.error) for r in answers.select("cached", "error").distinct().collect()}
    assert {(0, None), (None, M.FAILED), (None, "no url")} <= kinds


def test_labels_differ_as_the_report_says(spark):
    lists = [[], [None], [0], [1], [0, 1], [0, 0], [None, 0]]
    for a, b in itertools.product(lists, lists):
        first, second = (
            spark.createDataFrame([(" u", x) for x in side] + [(None, 5), (f"only{k}", k)], "url string, label int")
            for k, side in enumerate((a, b)))
        want = any(x != y for x in a for y in b)
        assert clean.labels_differ(first, second) == want, (a, b)
