"""Summaries of token attributions ``(sample_id, pos, token, class_idx, value)``."""

from __future__ import annotations

from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# --- fixed values: tokens that stand for no text, strength limits ---------------------------------
SPECIAL_TOKENS = ["", "[CLS]", "[SEP]", "[PAD]"]
STRONG, MEDIUM = 0.05, 0.02

CHUNK = 1024


def repaired(attributions: DataFrame) -> DataFrame:
    """NaN values become 0."""
    return attributions.withColumn("value", F.nanvl("value", F.lit(0.0)))


def repaired_bases(bases: DataFrame) -> DataFrame:
    """NaN base values become 0.5."""
    return bases.withColumn("base", F.nanvl("base", F.lit(0.5)))


def nan_report(attributions: DataFrame) -> DataFrame:
    """n_values, n_nan, all_nan."""
    n_nan = F.sum(F.isnan("value").cast("long"))
    return attributions.agg(
        F.count("*").alias("n_values"), F.coalesce(n_nan, F.lit(0)).alias("n_nan")
    ).withColumn("all_nan", (F.col("n_nan") == F.col("n_values")).cast("int"))


def of_class(attributions: DataFrame, class_idx: int = 1) -> DataFrame:
    return attributions.filter(F.col("class_idx") == class_idx)


def _real_token() -> Column:
    return ~F.trim("token").isin(SPECIAL_TOKENS)


def token_frequency(attributions: DataFrame, k: int) -> DataFrame:
    """token, n of the k most frequent tokens (one count per sample and position)."""
    return (
        of_class(attributions)
        .filter(_real_token())
        .groupBy(F.trim("token").alias("token"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "token")
        .limit(k)
    )


def token_matrix(attributions: DataFrame, k: int) -> DataFrame:
    """sample_id, token, value (sum for class 1), present for the k most frequent tokens."""
    top = token_frequency(attributions, k).select("token")
    return (
        of_class(attributions)
        .withColumn("token", F.trim("token"))
        .join(top, "token", "left_semi")
        .groupBy("sample_id", "token")
        .agg(F.sum("value").alias("value"), F.lit(1).alias("present"))
    )


def token_ids(attributions: DataFrame, k: int) -> DataFrame:
    """token, id of the k most frequent tokens, the most frequent first."""
    order = W.orderBy(F.desc("n"), "token")  # at most k rows
    return token_frequency(attributions, k).select("token", (F.row_number().over(order) - 1).cast("int").alias("id"))


def token_vectors(attributions: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """sample_id, features: one sparse vector of size k per sample with the sums of class 1 by token id.

    ``ids`` has token and id below k (:func:`token_ids`), and may be of any length: it is joined, not made
    columns. A sample without any of the tokens has an empty vector. A token that adds up to 0 stays an
    explicit entry.
    """
    sums = (
        of_class(attributions)
        .withColumn("token", F.trim("token"))
        .groupBy("sample_id", "token")
        .agg(F.sum("value").alias("value"))
        .join(ids, "token", "left")
    )
    entry = F.when(F.col("id").isNotNull(), F.struct("id", F.coalesce("value", F.lit(0.0)).alias("value")))
    sparse = F.udf(
        lambda entries: SparseVector(k, [e["id"] for e in entries], [e["value"] for e in entries]), VectorUDT())
    lists = sums.groupBy("sample_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    return lists.select("sample_id", sparse("entries").alias("features"))


def vector_entries(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """sample_id, token, value, present: the entries of token vectors as rows, as :func:`token_matrix` has them."""
    entries = F.udf(
        lambda v: [(int(i), float(x)) for i, x in zip(v.indices, v.values)], "array<struct<id: int, value: double>>")
    rows = vectors.select("sample_id", F.inline(entries("features")))
    return rows.join(ids, "id").select("sample_id", "token", "value", F.lit(1).alias("present"))


def token_matrix_wide(attributions: DataFrame, tokens: list[str]) -> DataFrame:
    """sample_id and one value column per given token, 0 where it is absent."""
    return (
        of_class(attributions)
        .withColumn("token", F.trim("token"))
        .groupBy("sample_id")
        .pivot("token", tokens)
        .agg(F.sum("value"))
        .fillna(0.0)
    )


def sample_summary(attributions: DataFrame) -> DataFrame:
    """sample_id, pred_class (largest mean value), mean_abs over all tokens and classes."""
    per_class = attributions.groupBy("sample_id", "class_idx").agg(
        F.avg("value").alias("_mean"),
        F.sum(F.abs("value")).alias("_abs"),
        F.count("*").alias("_n"),
    )
    best = F.max(F.struct("_mean", (-F.col("class_idx")).alias("_back")))
    return per_class.groupBy("sample_id").agg(
        (-best["_back"]).alias("pred_class"), (F.sum("_abs") / F.sum("_n")).alias("mean_abs")
    )


def top_tokens(attributions: DataFrame, n: int, class_idx: int = 1) -> DataFrame:
    """The n tokens of every sample with the largest absolute value, with their rank.

    The filter on the rank lets Spark keep n rows per sample before the shuffle.
    """
    order = W.partitionBy("sample_id").orderBy(F.desc(F.abs("value")), "pos")
    return (
        of_class(attributions, class_idx)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("sample_id", "rank", "pos", "token", "value")
    )


def direction(value: Column) -> Column:
    return F.when(value > 0, "benign").otherwise("phish")


def token_table(attributions: DataFrame, class_idx: int = 1) -> DataFrame:
    """One row per real token: position, value, absolute value, impact, strength, direction."""
    size = F.abs("value")
    # fixed values: the names of impact and strength
    impact = "Push to Benign" if class_idx == 1 else "Push to Phishing"
    return (
        of_class(attributions, class_idx)
        .filter(_real_token())
        .select(
            "sample_id",
            F.col("pos").alias("position"),
            "token",
            "value",
            size.alias("abs_value"),
            F.lit(impact).alias("impact"),
            F.when(size > STRONG, "Strong").when(size > MEDIUM, "Medium").otherwise("Weak").alias(
                "strength"
            ),
            direction(F.col("value")).alias("direction"),
        )
    )


def sorted_token_table(attributions: DataFrame, class_idx: int = 1) -> DataFrame:
    return token_table(attributions, class_idx).orderBy(
        "sample_id", F.desc("abs_value"), "position"
    )


def cumulative_values(
    attributions: DataFrame, class_idx: int = 1, marked: int = 10, whole_samples: bool = False
) -> DataFrame:
    """Running sum of the value over the positions of each sample; the top tokens are marked.

    With ``whole_samples`` the rows of a sample lie in one partition already (``tables.grouped_by_key``), and
    one pass over them sums and ranks without a shuffle or a join. Otherwise a sample is cut into chunks of
    positions that are summed on their own, so a very long sample does not end in one task. The rows are
    shuffled once, by chunk: the sums before a chunk and the last of the top tokens come from small tables
    of at most one row and ``marked`` rows per chunk.
    """
    size = F.struct((-F.abs("value")).alias("size"), "pos")
    chunk, sample = W.partitionBy("sample_id", "_chunk"), W.partitionBy("sample_id")
    if whole_samples:
        places = F.rank().over(sample.orderBy(-F.abs("value"), "pos"))
        so_far = F.sum("value").over(sample.orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
        return of_class(attributions, class_idx).select(
            "sample_id", "pos", "token", "value", so_far.alias("cumulative"),
            (places <= marked).cast("int").alias("is_top"),
        )
    rows = of_class(attributions, class_idx).withColumn("_chunk", F.floor(F.col("pos") / CHUNK)).withColumns({
        "_inside": F.sum("value").over(chunk.orderBy("pos").rowsBetween(W.unboundedPreceding, 0)),
        "_place": F.row_number().over(chunk.orderBy(size)),
        "_sum": F.sum("value").over(chunk),
    })
    first = F.col("_place") == 1
    # a chunk hands on its sum, once, and its largest values
    best = rows.filter((F.col("_place") <= marked) | first).select(
        "sample_id", "_chunk", "_place", "_sum", size.alias("_size"))
    earlier = sample.orderBy("_chunk").rangeBetween(W.unboundedPreceding, -1)
    ranked = best.withColumns({
        "_before": F.coalesce(F.sum(F.when(first, F.col("_sum"))).over(earlier), F.lit(0.0)),
        "_rank": F.row_number().over(sample.orderBy("_size")),
    })
    per_chunk = ranked.withColumn(
        "_last", F.max(F.when(F.col("_rank") <= marked, F.col("_size"))).over(sample)
    ).filter(first).select("sample_id", "_chunk", "_before", "_last")
    return rows.join(per_chunk, ["sample_id", "_chunk"]).select(
        "sample_id", "pos", "token", "value",
        (F.col("_inside") + F.col("_before")).alias("cumulative"),
        (size <= F.col("_last")).cast("int").alias("is_top"),
    )


def both_classes(attributions: DataFrame, n: int) -> DataFrame:
    """Top n tokens per sample by mean absolute value, with the value of either class."""

    def value_of(k: int) -> Column:
        return F.sum(F.when(F.col("class_idx") == k, F.col("value")))

    tokens = attributions.groupBy("sample_id", "pos", "token").agg(
        F.avg(F.abs("value")).alias("mean_abs"),
        value_of(0).alias("phishing"),
        value_of(1).alias("benign"),
    )
    order = W.partitionBy("sample_id").orderBy(F.desc("mean_abs"), "pos")
    return tokens.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def decision_path(
    attributions: DataFrame, bases: DataFrame, n: int = 20, class_idx: int = 1
) -> DataFrame:
    """Path from the base value to the output over the n most important tokens of each sample.

    ``path`` at rank r is the output once all tokens of rank r and below have been added. The rows are
    shuffled once, by chunk of positions; a chunk hands on its sum and its n largest values.
    """
    size = F.struct((-F.abs("value")).alias("size"), "pos")
    chunk, sample = W.partitionBy("sample_id", "_chunk"), W.partitionBy("sample_id")
    best = (
        of_class(attributions, class_idx)
        .withColumn("_chunk", F.floor(F.col("pos") / CHUNK))
        .withColumns({"_place": F.row_number().over(chunk.orderBy(size)), "_sum": F.sum("value").over(chunk)})
        .filter(F.col("_place") <= n)
    )
    ranked = best.withColumns({
        "_total": F.sum(F.when(F.col("_place") == 1, F.col("_sum"))).over(sample),
        "rank": F.row_number().over(sample.orderBy(size)),
    }).filter(F.col("rank") <= n)
    higher = sample.orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    more_important = F.coalesce(F.sum("value").over(higher), F.lit(0.0))
    return (
        ranked.withColumn("_more", more_important)
        .join(of_class(bases, class_idx).select("sample_id", "base"), "sample_id")
        .select(
            "sample_id", "rank", "pos", "token", "value", "base",
            (F.col("base") + F.col("_total") - F.col("_more")).alias("path"),
        )
    )
