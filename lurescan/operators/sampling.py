"""Reproducible splits and samples.

Rows are ordered by ``md5(key, seed)``, rows of one key by a hash of the whole row. A quota per class
is met by a threshold on that order, found in two small steps: counts per hash prefix, then the rows
of the one prefix that holds the cut. The choice itself is a filter, so a class with most of the rows
is never sorted or shuffled as a whole. NULL is a class of its own. Only rows that are equal in every
column cannot be told apart; they are chosen together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescan.operators.tables import attach, with_row_number

PREFIX_DIGITS = 5


def order_hash(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def mark_by_quota(
    df: DataFrame, key: str, quota: Callable[[Column], Column], seed: int, by: str | None = None
) -> DataFrame:
    """Add ``picked``: the rows with the smallest hashes, ``quota(class size)`` of each class."""
    classes = F.col(by) if by else F.lit(0)
    plain = [f.name for f in df.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    whole = F.lpad(F.hex(F.xxhash64(*plain)), 16, "0")
    hashed = df.withColumns({"_class": classes, "_hash": F.concat(order_hash(key, seed), whole)})
    keyed = hashed.select("_class", "_hash", F.substring("_hash", 1, PREFIX_DIGITS).alias("_prefix"))

    counts = keyed.groupBy("_class", "_prefix").agg(F.count("*").alias("_n"))
    by_prefix = W.partitionBy("_class").orderBy("_prefix").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("_n").over(W.partitionBy("_class"))
    cuts = (
        counts.withColumns({"_upto": F.sum("_n").over(by_prefix), "_quota": quota(total)})
        .filter(
            (F.col("_quota") > 0)
            & (F.col("_upto") >= F.col("_quota"))
            & (F.col("_upto") - F.col("_n") < F.col("_quota"))
        )
        .select("_class", "_prefix", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    )
    in_cut = attach(keyed, cuts, ["_class", "_prefix"], "inner")
    rank = F.row_number().over(W.partitionBy("_class").orderBy("_hash"))
    thresholds = (
        in_cut.withColumn("_rank", rank)
        .filter(F.col("_rank") == F.col("_need"))
        .select("_class", F.col("_hash").alias("_limit"))
    )
    marked = attach(hashed, thresholds, ["_class"])
    return marked.withColumn(
        "picked", F.coalesce(F.col("_hash") <= F.col("_limit"), F.lit(False))
    ).drop("_class", "_hash", "_limit")


def _share(fraction: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(n * F.lit(fraction) + F.lit(0.5)).cast("bigint")


def _named(df: DataFrame, if_picked: str, otherwise: str) -> DataFrame:
    return df.withColumn(
        "split", F.when(F.col("picked"), if_picked).otherwise(otherwise)
    ).drop("picked")


def stratified_split(
    df: DataFrame, key: str, label: str = "label", test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train or test) with the same test share of every class."""
    return _named(mark_by_quota(df, key, _share(test_share), seed, label), "test", "train")


def random_split(df: DataFrame, key: str, test_share: float = 0.1, seed: int = 42) -> DataFrame:
    return _named(mark_by_quota(df, key, _share(test_share), seed), "validation", "train")


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in hash order (a range-partitioned sort)."""
    return df.orderBy(order_hash(key, seed), key)


def shuffled_positions(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Add ``position``, from 1, in the order of :func:`shuffled`.

    The parts of the order are ranges of the hash; each is numbered on its own.
    """
    placed = df.withColumn("_hash", order_hash(key, seed))
    numbered = with_row_number(placed, "_hash", "position", ties=[key])
    return numbered.withColumn("position", F.col("position") + 1).drop("_hash")


def sample_exactly(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows; all rows if there are fewer."""
    quota = lambda total: F.least(total, F.lit(n))
    return mark_by_quota(df, key, quota, seed).filter("picked").drop("picked")


def sample_per_class(
    df: DataFrame, key: str, n: int, label: str = "label", seed: int = 42
) -> DataFrame:
    """Exactly n rows of every class; a class with fewer rows is an error."""
    short = F.raise_error(F.lit(f"a class has fewer than {n} rows")).cast("bigint")
    quota = lambda total: F.when(total >= n, F.lit(n)).otherwise(short)
    return mark_by_quota(df, key, quota, seed, label).filter("picked").drop("picked")


def sample_up_to(
    df: DataFrame, key: str, n: int, label: str = "label", seed: int = 42
) -> DataFrame:
    """n rows of every class, or the whole class if it is smaller."""
    quota = lambda total: F.least(total, F.lit(n))
    return mark_by_quota(df, key, quota, seed, label).filter("picked").drop("picked")


def second_sample(
    df: DataFrame, first: DataFrame, key: str, n: int, label: str = "label", seed: int = 42
) -> DataFrame:
    """Balanced sample that shares no row with ``first``."""
    return sample_per_class(df.join(first.select(key), key, "left_anti"), key, n, label, seed)


def last_rows_split(df: DataFrame, order: str, share: float = 0.15) -> DataFrame:
    """Add ``split``: the last rows in the order of a distinct numeric column are validation."""
    numbered = with_row_number(df.select(order), order)
    counted = numbered.agg(F.floor(F.count("*") * F.lit(1 - share)).alias("at")).scalar()
    first = numbered.filter(F.col("row_idx") == counted).agg(F.min(order)).scalar()
    return df.withColumn(
        "split",
        F.when(F.coalesce(F.col(order) >= first, F.lit(False)), "validation").otherwise("train"),
    )


def row_range(df: DataFrame, order: str, start: int, end: int) -> DataFrame:
    """Rows ``[start, end)`` by position, with the position as ``row_idx``; bounds are checked.

    Only the order column is numbered; the rows themselves are filtered by the two values found.
    """
    numbered = with_row_number(df.select(order), order)
    n = numbered.count()
    if start < 0 or end > n or start >= end:
        raise ValueError(f"bad range [{start}, {end}) of {n} rows")
    wanted = numbered.filter(F.col("row_idx").between(start, end - 1))
    bounds = wanted.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.count(order).alias("n")).first()
    inside = F.col(order).between(bounds["low"], bounds["high"])
    rows = df.filter(inside | F.col(order).isNull() if bounds["n"] < end - start else inside)
    return attach(rows, wanted, [order], "inner")


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """label, n and weight = rows / (classes * n)."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return (
        counts.withColumn("_all", totals)
        .withColumn("weight", F.col("_all.rows") / (F.col("_all.classes") * F.col("n")))
        .drop("_all")
    )


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    return attach(df, class_weights(df, label).select(label, "weight"), [label])


def sample_composition(df: DataFrame, sample: str = "sample", label: str = "label") -> DataFrame:
    """sample, total and rows per class."""
    return df.groupBy(sample).agg(
        F.count("*").alias("total"),
        F.sum((F.col(label) == 1).cast("int")).alias("benign"),
        F.sum((F.col(label) == 0).cast("int")).alias("phishing"),
    )
