"""Cleaning, de-duplication and merging of URL tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescan.functions.url import strip
from lurescan.operators.tables import attach, join_split_hot, missing

IMBALANCE_LIMIT = 1.5


def normalise(df: DataFrame) -> DataFrame:
    """Trimmed url, whole-number label (a label that is no number becomes NULL)."""
    return df.withColumns(
        {"url": strip(F.col("url")), "label": F.col("label").try_cast("double").cast("int")}
    )


def _first_rows(df: DataFrame, order: str) -> DataFrame:
    return df.groupBy("url").agg(F.min(order).alias(order))


def dedup_by_url(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """Keep the first row per trimmed url.

    ``min_by`` is combined before the shuffle, so a url that holds a large share of the rows sends
    one row per task.
    """
    rows = normalise(df)
    first = F.min_by(F.struct(*rows.columns), F.col(order)).alias("_row")
    return rows.groupBy("url").agg(first).select("_row.*")


def duplicate_report(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """The rows that :func:`dedup_by_url` removes.

    The anti join is on the row number, which is unique, so a frequent url does not skew it.
    """
    rows = normalise(df)
    return rows.join(_first_rows(rows, order).select(order), order, "left_anti")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n and share of every value of a column, NULL included."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = df.groupBy().agg(F.count("*").alias("total")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def missing_report(df: DataFrame) -> DataFrame:
    """column, n_missing for each column, plus the row ``(any)`` for rows with any missing value."""
    tests = {c: missing(c, t) for c, t in df.dtypes}
    any_missing = F.lit(False)
    for test in tests.values():
        any_missing = any_missing | test
    tests["(any)"] = any_missing
    counts = df.agg(
        *[
            F.coalesce(F.sum(t.cast("long")), F.lit(0)).alias(f"c{i}")
            for i, t in enumerate(tests.values())
        ]
    )
    pairs = [
        F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("n_missing"))
        for i, c in enumerate(tests)
    ]
    return counts.select(F.inline(F.array(*pairs)))


def drop_missing_rows(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def drop_missing_cols(df: DataFrame) -> DataFrame:
    """Drop every column with a missing value (reads one count per column)."""
    report = missing_report(df).filter("n_missing > 0 AND column != '(any)'")
    return df.drop(*[row["column"] for row in report.collect()])


def missing_urls(df: DataFrame, other: DataFrame) -> DataFrame:
    """url, label of the rows whose trimmed url is not in ``other``."""
    known = other.select(strip(F.col("url")).alias("url")).distinct()
    trimmed = df.select(strip(F.col("url")).alias("url"), "label")
    return join_split_hot(trimmed, known, "url", "left_anti")


def keep_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The known ones of the named columns, in the given order; all if none is known."""
    known = [c for c in columns if c in df.columns]
    return df.select(*known) if known else df


def drop_cols(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def add_const_col(df: DataFrame, column: str, value) -> DataFrame:
    return df.withColumn(column, F.lit(value))


def label_mismatch_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """url, label_first, label_second of joined rows whose labels differ; NULL differs from a value."""
    a = normalise(first).select("url", F.col("label").alias("label_first"))
    b = normalise(second).select("url", F.col("label").alias("label_second"))
    return join_split_hot(a, b, "url", "inner").filter("NOT (label_first <=> label_second)")


def labels_differ(first: DataFrame, second: DataFrame) -> bool:
    """Whether some joined pair of rows has different labels; NULL differs from a value.

    A url of both tables has such a pair if it has two labels in all, so one aggregate by url is enough.
    """
    a, b = (normalise(df).select("url", "label") for df in (first, second))
    if a.schema["label"].dataType != b.schema["label"].dataType:
        return not label_mismatch_report(first, second).isEmpty()
    sides = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2))).filter("url IS NOT NULL")
    label = F.col("label")
    by_url = sides.groupBy("url").agg(
        F.min("_side").alias("_from"), F.max("_side").alias("_to"), F.min(label).alias("_least"),
        F.max(label).alias("_most"), F.count(label).alias("_known"), F.count("*").alias("_n"))
    two = (F.col("_least") != F.col("_most")) | F.col("_known").between(1, F.col("_n") - 1)
    return not by_url.filter((F.col("_from") < F.col("_to")) & two).isEmpty()


def merge_on_url(first: DataFrame, second: DataFrame) -> DataFrame:
    """Inner join on trimmed url with the label column(s) last.

    Columns in both tables get ``_first`` and ``_second``. If the labels of all joined rows agree
    there is one ``label`` column (see :func:`labels_differ`).
    """
    a, b = normalise(first), normalise(second)
    shared = [c for c in a.columns if c in b.columns and c != "url"]
    left = a.withColumnsRenamed({c: f"{c}_first" for c in shared})
    right = b.withColumnsRenamed({c: f"{c}_second" for c in shared})
    merged = join_split_hot(left, right, "url", "inner")
    if "label" not in shared:
        return merged
    if not labels_differ(first, second):
        merged = merged.drop("label_second").withColumnRenamed("label_first", "label")
    labels = [c for c in ("label", "label_first", "label_second") if c in merged.columns]
    return merged.select(*[c for c in merged.columns if c not in labels], *labels)


def one_sided_report(first: DataFrame, second: DataFrame) -> DataFrame:
    """url, label, side of the urls that only one table has."""
    return (
        missing_urls(first, second)
        .withColumn("side", F.lit("first"))
        .unionByName(missing_urls(second, first).withColumn("side", F.lit("second")))
    )


STEPS: dict[str, Callable[..., DataFrame]] = {
    "dedup_by_url": dedup_by_url,
    "drop_missing_rows": drop_missing_rows,
    "drop_missing_cols": drop_missing_cols,
    "drop_cols": drop_cols,
    "keep_cols": keep_cols,
    "add_const_col": add_const_col,
    "merge_on_url": merge_on_url,
}


def clean_pipeline(df: DataFrame, steps: Sequence[tuple]) -> DataFrame:
    """Apply named steps in order: ``[("dedup_by_url",), ("drop_cols", ["x"])]``."""
    unknown = [name for name, *_ in steps if name not in STEPS]
    if unknown:
        raise ValueError(f"unknown steps {unknown}; known: {sorted(STEPS)}")
    for name, *args in steps:
        df = df.transform(STEPS[name], *args)
    return df


def coerce_label(df: DataFrame) -> DataFrame:
    """Label as a number, rows without one dropped."""
    number = F.col("label").try_cast("double")
    return (
        df.withColumn("label", number)
        .filter(F.col("label").isNotNull() & ~F.isnan("label"))
        .withColumn("label", F.col("label").cast("int"))
    )


def missing_label_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("label").isNull())


def describe_label(df: DataFrame, column: str = "label") -> DataFrame:
    """count, mean, sample standard deviation, min, exact quartiles and max as one row."""
    c = F.col(column).cast("double")
    # exact percentiles keep one counter per distinct value, and labels have few
    return df.agg(
        F.count(c).alias("count"),
        F.avg(c).alias("mean"),
        F.stddev_samp(c).alias("std"),
        F.min(c).alias("min"),
        F.percentile(c, F.lit(0.25)).alias("p25"),
        F.percentile(c, F.lit(0.5)).alias("p50"),
        F.percentile(c, F.lit(0.75)).alias("p75"),
        F.max(c).alias("max"),
    )


def class_distribution(df: DataFrame, split: str = "split") -> DataFrame:
    """split, label, n and share within the split."""
    counts = df.groupBy(split, "label").agg(F.count("*").alias("n"))
    totals = counts.groupBy(split).agg(F.sum("n").alias("_total"))
    return attach(counts, totals, [split], "inner").select(
        split, "label", "n", (F.col("n") / F.col("_total")).alias("share")
    )


def balance_report(df: DataFrame, split: str = "split") -> DataFrame:
    """Counts and percentages of the two classes per split, imbalance ratio and a flag."""
    n = F.count("*")
    phishing, benign = (F.sum((F.col("label") == k).cast("int")) for k in (0, 1))
    ratio: Column = F.try_divide(F.greatest("phishing", "benign"), F.least("phishing", "benign"))
    return (
        df.groupBy(split)
        .agg(n.alias("total"), phishing.alias("phishing"), benign.alias("benign"))
        .withColumns(
            {
                "phishing_pct": 100 * F.col("phishing") / F.col("total"),
                "benign_pct": 100 * F.col("benign") / F.col("total"),
                "imbalance": ratio,
            }
        )
        .withColumn(
            "is_imbalanced",
            F.coalesce(F.col("imbalance") > IMBALANCE_LIMIT, F.lit(True)).cast("int"),
        )
    )


def label_text(label: Column) -> Column:
    return F.when(label == 0, "phishing").when(label == 1, "benign")
