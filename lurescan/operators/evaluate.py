"""Evaluation of scored rows ``(label, score, pred)``; class 1 is the positive class.

Curves need one running sum over all distinct scores. It is built from parts of the score range, so
no task orders all rows. Each point knows the counts before it (its running sum less its own), so
areas are plain sums without looking at the neighbouring row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.operators.tables import attach, cut_lineage, running_totals

HISTOGRAM_BINS = 50


def count_if(test: Column) -> Column:
    return F.coalesce(F.sum(test.cast("long")), F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def confusion_counts(df: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn, n."""
    positive, predicted = F.col("label") == 1, F.col("pred") == 1
    return df.agg(
        count_if(positive & predicted).alias("tp"),
        count_if(~positive & predicted).alias("fp"),
        count_if(positive & ~predicted).alias("fn"),
        count_if(~positive & ~predicted).alias("tn"),
        F.count("*").alias("n"),
    )


def _rows(df: DataFrame, rows: list[dict[str, Column]]) -> DataFrame:
    """One output row per dict of columns, from a one-row table."""
    structs = [F.struct(*[v.alias(k) for k, v in row.items()]) for row in rows]
    return df.select(F.inline(F.array(*structs)))


def confusion_matrix(df: DataFrame) -> DataFrame:
    """label, pred, n for all four cells."""
    cells = [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]
    return _rows(
        confusion_counts(df),
        [{"label": F.lit(a), "pred": F.lit(b), "n": F.col(c)} for a, b, c in cells],
    )


def _class_scores(hit: str, wrong: str, lost: str) -> tuple[Column, Column, Column, Column]:
    h, w, m = F.col(hit), F.col(wrong), F.col(lost)
    return ratio(h, h + w), ratio(h, h + m), ratio(2 * h, 2 * h + w + m), h + m


def classification_report(df: DataFrame) -> DataFrame:
    """name, precision, recall, f1, support for both classes, accuracy, macro and weighted mean."""
    p0, r0, f0, n0 = _class_scores("tn", "fn", "fp")
    p1, r1, f1, n1 = _class_scores("tp", "fp", "fn")
    n = F.col("n")
    accuracy = ratio(F.col("tp") + F.col("tn"), n)

    def row(name: str, p: Column, r: Column, f: Column, support: Column) -> dict[str, Column]:
        return {"name": F.lit(name), "precision": p, "recall": r, "f1": f, "support": support}

    def weighted(a: Column, b: Column) -> Column:
        return ratio(a * n0 + b * n1, n)

    return _rows(
        confusion_counts(df),
        [
            row("0", p0, r0, f0, n0),
            row("1", p1, r1, f1, n1),
            row("accuracy", accuracy, accuracy, accuracy, n),
            row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
            row("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f0, f1), n),
        ],
    )


def binary_metrics(df: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall, f1, fpr, fnr."""
    return _binary_metrics(confusion_counts(df))


def _binary_metrics(counts: DataFrame) -> DataFrame:
    p, r, f, _ = _class_scores("tp", "fp", "fn")
    return counts.select(
        ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        p.alias("precision"),
        r.alias("recall"),
        f.alias("f1"),
        ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
        ratio(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"),
    )


def score_counts(df: DataFrame) -> DataFrame:
    """score, pred, rows of class 1, of class 0 and in all; stored, since summaries read it often."""
    counts = df.groupBy("score", "pred").agg(
        count_if(F.col("label") == 1).alias("_pos"),
        count_if(F.col("label") == 0).alias("_neg"),
        F.count("*").alias("_n"),
    )
    return cut_lineage(counts)


def score_points(df: DataFrame) -> DataFrame:
    """score, tp, fp, tp_before, fp_before per distinct score: rows at or above, and above, it."""
    counts = df.groupBy("score").agg(
        count_if(F.col("label") == 1).alias("_pos"), count_if(F.col("label") == 0).alias("_neg")
    )
    return _points(counts)


def _points(counts: DataFrame) -> DataFrame:
    running = running_totals(counts, "score", {"tp": "_pos", "fp": "_neg"}, descending=True)
    return running.select(
        "score",
        "tp",
        "fp",
        (F.col("tp") - F.col("_pos")).alias("tp_before"),
        (F.col("fp") - F.col("_neg")).alias("fp_before"),
        F.col("tp_total").alias("positives"),
        F.col("fp_total").alias("negatives"),
    )


def _end_point(df: DataFrame, **values) -> DataFrame:
    """One extra row for the end of a curve."""
    types = {f.name: f.dataType for f in df.schema.fields}
    row = df.sparkSession.range(1).select(
        *[F.lit(values.get(c)).cast(types[c]).alias(c) for c in df.columns]
    )
    return df.unionByName(row)


def precision_recall_curve(df: DataFrame) -> DataFrame:
    """threshold, precision, recall per distinct score, and the end point (NULL, 1, 0)."""
    points = score_points(df).select(
        F.col("score").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("positives")).alias("recall"),
    )
    return _end_point(points, precision=1.0, recall=0.0)


def roc_curve(df: DataFrame) -> DataFrame:
    """threshold, fpr, tpr per distinct score, and the start point (NULL, 0, 0)."""
    points = score_points(df).select(
        F.col("score").alias("threshold"),
        ratio(F.col("fp"), F.col("negatives")).alias("fpr"),
        ratio(F.col("tp"), F.col("positives")).alias("tpr"),
    )
    return _end_point(points, fpr=0.0, tpr=0.0)


def areas(df: DataFrame) -> DataFrame:
    """One row: pr_auc (trapezoid), average_precision and roc_auc (ties count half)."""
    return _areas(score_points(df))


def _areas(points: DataFrame) -> DataFrame:
    tp, fp, tp0, fp0 = (F.col(c) for c in ("tp", "fp", "tp_before", "fp_before"))
    precision = ratio(tp, tp + fp)
    before = F.when(tp0 + fp0 == 0, F.lit(1.0)).otherwise(ratio(tp0, tp0 + fp0))
    step = ratio(tp - tp0, F.col("positives"))
    fpr_step = ratio(fp - fp0, F.col("negatives"))
    mean_tpr = ratio(tp + tp0, 2 * F.col("positives"))
    return points.agg(
        F.sum(step * (precision + before) / 2).alias("pr_auc"),
        F.sum(step * precision).alias("average_precision"),
        F.sum(fpr_step * mean_tpr).alias("roc_auc"),
    )


def score_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """label, bin, lower, n: equal bins between the smallest and largest score of each class."""
    ranges = df.groupBy("label").agg(F.min("score").alias("_min"), F.max("score").alias("_max"))
    flat = F.col("_min") == F.col("_max")
    ranges = ranges.select(
        "label",
        F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min")).alias("_low"),
        F.when(flat, 1.0).otherwise(F.col("_max") - F.col("_min")).alias("_width"),
    )
    place = F.floor((F.col("score") - F.col("_low")) / F.col("_width") * bins).cast("int")
    counts = (
        attach(df, ranges, ["label"], "inner")
        .groupBy("label", F.least(place, F.lit(bins - 1)).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    grid = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return attach(grid, counts, ["label", "bin"]).select(
        "label",
        "bin",
        (F.col("_low") + F.col("bin") * F.col("_width") / bins).alias("lower"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def top_importances(importances: DataFrame, n: int) -> DataFrame:
    """The n largest of ``(feature, importance)``."""
    return importances.orderBy(F.desc("importance"), "feature").limit(n)


def evaluated_steps(history: DataFrame, metric: str = "eval_loss") -> DataFrame:
    """Rows of the training history in which the evaluation ran."""
    return history.filter(F.col(metric).isNotNull())


def best_step(history: DataFrame, metric: str) -> DataFrame:
    """step and value of the largest metric; the earliest step on a tie."""
    best = F.max(F.struct(F.col(metric).alias("value"), (-F.col("step")).alias("_back")))
    return (
        evaluated_steps(history, metric)
        .agg(best.alias("_best"))
        .select((-F.col("_best._back")).alias("step"), F.col("_best.value").alias("value"))
    )


def metric_summary(df: DataFrame) -> DataFrame:
    """metric, value in report order; the scored rows are read once."""
    names = [
        "accuracy", "roc_auc", "pr_auc", "average_precision", "precision", "recall", "f1", "fpr",
        "fnr",
    ]
    counts = score_counts(df)
    predicted = F.coalesce(F.col("pred") == 1, F.lit(False))
    cells = counts.agg(*[
        F.coalesce(F.sum(F.when(test, F.col(c))), F.lit(0)).alias(name)
        for name, test, c in (
            ("tp", predicted, "_pos"), ("fp", predicted, "_neg"), ("fn", ~predicted, "_pos"), ("tn", ~predicted, "_neg"),
        )
    ], F.coalesce(F.sum("_n"), F.lit(0)).alias("n"))
    by_score = counts.groupBy("score").agg(F.sum("_pos").alias("_pos"), F.sum("_neg").alias("_neg"))
    from_curve = _areas(_points(by_score)).select(F.struct("roc_auc", "pr_auc", "average_precision")).scalar()
    joined = _binary_metrics(cells).withColumn("_areas", from_curve).select("*", "_areas.*")
    return _rows(joined, [{"metric": F.lit(m), "value": F.col(m)} for m in names])
