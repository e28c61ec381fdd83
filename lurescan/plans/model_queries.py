"""Checks of trained models that SQL can state: every row scored, probabilities in range, better than
always naming the larger class, importances that sum to one."""

from pyspark.sql import functions as F

from lurescan.operators import scoring as J
from lurescan.operators.evaluate import top_importances
from lurescan.plans.registry import Tables, query
from lurescan.plans.serving_queries import trainable

CHECK_SPEC = "n:i n_rows:i in_range:i agrees:i better:i"
CHECK_SQL = "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_rows, 1 AS in_range, 1 AS agrees, 1 AS better FROM embeddings"


def checked(t: Tables, fit):
    rows = trainable(t)
    scored = J.score_with(fit(rows), rows)
    hit, one = (F.col("pred") == F.col("label")), F.col("label") == 1
    share = F.avg(one.cast("double"))
    return scored.agg(
        F.count("*").alias("n"),
        F.countDistinct("vec_id").alias("n_rows"),
        F.min(F.col("proba").between(0, 1).cast("int")).alias("in_range"),
        F.min((F.col("pred") == (F.col("proba") >= 0.5).cast("int")).cast("int")).alias("agrees"),
        (F.avg(hit.cast("double")) > F.greatest(share, 1 - share)).cast("int").alias("better"),
    )


@query("random_forest_check", CHECK_SPEC, CHECK_SQL)
def random_forest_check(t: Tables):
    return checked(t, J.fit_random_forest)


@query("boosted_tree_check", CHECK_SPEC, CHECK_SQL)
def boosted_tree_check(t: Tables):
    return checked(t, J.fit_boosted_trees)


@query("linear_margin_check", CHECK_SPEC, CHECK_SQL)
def linear_margin_check(t: Tables):
    return checked(t, J.fit_linear_margin)


@query(
    "importance_check",
    "n:i known:i falling:i whole:i",
    "SELECT max(len(embedding)) AS n, 1 AS known, 1 AS falling, 1 AS whole FROM embeddings",
)
def importance_check(t: Tables):
    """All importances in falling order: known names, none below zero, one in all."""
    rows = trainable(t)
    size = rows.agg(F.max(F.size("vector"))).first()[0]
    listed = top_importances(J.feature_importances(J.fit_random_forest(rows), rows), size)
    values = F.collect_list("importance")
    falling = F.forall(F.sequence(F.lit(1), F.size("v") - 1), lambda i: F.get("v", i) <= F.get("v", i - 1))
    known = F.col("feature").isin([f"v{i}" for i in range(size)])
    found = listed.agg(
        F.count("*").alias("n"), F.min((known & (F.col("importance") >= 0)).cast("int")).alias("known"),
        values.alias("v"), (F.abs(F.sum("importance") - 1) < 1e-9).cast("int").alias("whole"))
    return found.withColumn("falling", falling.cast("int"))
