"""URL tokens, word vectors, character sequences and chat examples."""

from __future__ import annotations

from pyspark.ml.feature import Word2Vec, Word2VecModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescan.functions import url as U
from lurescan.operators import word_vectors
from lurescan.operators.clean import label_text
from lurescan.operators.tables import join_split_hot

VECTOR_SIZE = 50
SEQUENCE_LENGTH = 200
WINDOW = 5
#: Tokens of a training partition; Word2Vec averages the partitions' vectors after each round.
TOKENS_PER_PARTITION = 10_000_000
#: Vocabulary up to which Spark's Word2Vec trains, by far the faster way: it sends about 450 bytes a token to the driver
#: in each round, so 73 MB at once, and 1.15 GB in 15 rounds with the vocabulary.
DRIVER_VOCABULARY = 160_000

# --- fixed values: chat example texts -------------------------------------------------------------
SYSTEM_TEXT = "You are a cybersecurity assistant that classifies URLs as phishing or benign."
USER_TEXT = "Classify the following URL:\n"


def url_tokens(url: Column, include_scheme: bool = True) -> Column:
    """Lower-case tokens of scheme, host, path and query; cleaning may leave an empty token."""
    text = F.lower(url)
    rest = F.regexp_replace(text, r"^(?:[a-z][a-z0-9+.\-]*:)?(?://[^/?#]*)?", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), r";[^/]*$", "")
    pieces = [
        F.split(U.url_netloc(text), r"\."),
        F.split(path, "/"),
        F.split(F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1), "&"),
    ]
    if include_scheme:
        pieces.insert(0, F.array(U.url_scheme(text)))
    filled = F.filter(F.concat(*pieces), lambda t: t != "")
    return F.transform(filled, lambda t: F.regexp_replace(t, r"[^a-z0-9\-/.=]", ""))


def truncated(tokens: Column, length: int) -> Column:
    return F.slice(tokens, F.lit(1), F.lit(length))


def word2vec_fit(
    df: DataFrame, tokens: str = "tokens", epochs: int = 15, min_count: int = 1, driver_vocabulary: int = DRIVER_VOCABULARY
) -> Word2VecModel | word_vectors.WordVectors:
    """Skip-gram vectors of size 50, window 5 (5 plus 10 epochs); every token kept by default.

    Spark's Word2Vec collects the vectors of all tokens on the driver after each round. A vocabulary of more than
    ``driver_vocabulary`` tokens is trained by the same method with its vectors on the executors. Token lists are
    not cut, and the training partitions follow from the number of tokens.
    """
    if word_vectors.token_counts(df, tokens, min_count).count() > driver_vocabulary:
        return word_vectors.fit(df, tokens, VECTOR_SIZE, WINDOW, epochs, TOKENS_PER_PARTITION, min_count)
    sizes = df.agg(F.sum(F.size(tokens)).alias("all"), F.max(F.size(tokens)).alias("longest")).first()
    return Word2Vec(
        vectorSize=VECTOR_SIZE, windowSize=WINDOW, minCount=min_count, maxIter=epochs, seed=42,
        maxSentenceLength=max(1, sizes["longest"] or 1),
        numPartitions=max(1, -(-(sizes["all"] or 0) // TOKENS_PER_PARTITION)),
        inputCol=tokens, outputCol="vector",
    ).fit(df)


def vectors_of(model: Word2VecModel | word_vectors.WordVectors) -> DataFrame:
    """token, vector (array of doubles)."""
    return model.getVectors().select(
        F.col("word").alias("token"), vector_to_array("vector").alias("vector")
    )


def url_vectors(
    df: DataFrame, vectors: DataFrame, key: str, tokens: str = "tokens", size: int = VECTOR_SIZE
) -> DataFrame:
    """Mean vector of the known tokens per row, zeros without any.

    Frequent tokens (a scheme, ``www``) fill most rows, so their rows are spread over several tasks.
    The mean is combined before the second shuffle.
    """
    long = df.select(key, F.explode_outer(tokens).alias("token"))
    known = join_split_hot(long, vectors, "token")
    means = known.groupBy(key).agg(
        *[F.avg(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(size)]
    )
    filled = [F.coalesce(f"v{i}", F.lit(0.0)) for i in range(size)]
    return means.select(key, F.array(*filled).alias("vector"))


def sequence_text(url: Column) -> Column:
    return F.regexp_replace(F.lower(url), r"(?U)\s+", "")


def char_vocabulary(df: DataFrame, url: str = "url") -> DataFrame:
    """char, n, id: ids from 1 by falling count, equal counts in character order.

    The ranked table has one row per distinct character, which Unicode bounds.
    """
    counts = (
        df.select(F.explode(F.split(sequence_text(F.col(url)), "")).alias("char"))
        .filter("char != ''")
        .groupBy("char")
        .agg(F.count("*").alias("n"))
    )
    return counts.withColumn("id", F.row_number().over(W.orderBy(F.desc("n"), "char")))


def _padded(ids: Column) -> Column:
    zeros = F.array_repeat(F.lit(0), SEQUENCE_LENGTH)
    return F.slice(F.concat(ids, zeros), 1, SEQUENCE_LENGTH)


def char_sequences(df: DataFrame, vocabulary: DataFrame, url: str = "url") -> DataFrame:
    """Add ``sequence``: ids of the known characters, cut to 200 and padded with 0 at the end.

    The vocabulary is one value in the plan: its characters as a string and their ids, in the same
    order. Unicode bounds it. Each row is mapped on its own.
    """
    listed = F.array_sort(F.collect_list(F.struct("id", "char")))
    known = vocabulary.agg(F.struct(
        F.array_join(F.transform(listed, lambda x: x["char"]), "").alias("chars"),
        F.transform(listed, lambda x: x["id"]).alias("ids"),
    )).scalar()
    chars = F.split(sequence_text(F.col(url)), "")
    places = F.transform(chars, lambda c: F.when(c != "", F.position(c, F.col("_known.chars"))).otherwise(0))
    ids = F.transform(F.filter(places, lambda p: p > 0), lambda p: F.get("_known.ids", p - 1))
    return df.withColumn("_known", known).withColumn("sequence", _padded(ids)).drop("_known")


def chat_messages(url: Column, label: Column) -> Column:
    """System, user and assistant message as ``array<struct<role, content>>``."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(SYSTEM_TEXT)),
        message("user", F.concat(F.lit(USER_TEXT), url)),
        message("assistant", label_text(label)),
    )


def chat_examples(df: DataFrame) -> DataFrame:
    return df.withColumn("messages", chat_messages(F.col("url"), F.col("label")))
