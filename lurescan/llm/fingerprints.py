"""Document fingerprints: threshold-scaled sketches of word shingles, in DataFrame functions only.

A sketch keeps every shingle hash below a fixed share of the hash range. The same hash is kept or left
out in every document, so sketches can be merged by union and a sketch of a short text can be looked
for in that of a long one. A text without a hash below the threshold keeps its least hash, which no
sketch of a text with a hash below need have: it is looked for among all hashes of the other text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lurescan.functions.url import let
from lurescan.llm.text import stored

SHINGLE = 5

#: One of so many hashes is kept.
SCALE = 8

BLANKS = "\\s+"


def limit(scale: int) -> int:
    """The largest hash that is kept."""
    return -(2**63) + 2**64 // scale if scale > 1 else 2**63 - 1


def shingle_hashes(text: Column, shingle: int = SHINGLE) -> Column:
    """Hashes of a text's word shingles in order; fewer words than a shingle are one shingle, no words
    none. Words are what white space separates, in lower case."""
    def of_words(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        return let(hashes, lambda h: F.transform(
            F.sequence(F.lit(0), F.size(h) - shingle),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)])))

    def of(words: Column) -> Column:
        return F.when(F.size(words) >= shingle, of_words(words)).otherwise(F.array(F.xxhash64(words)))

    clean = F.regexp_replace(F.lower(text), "^\\s+|\\s+$", "")
    none = F.array().cast("array<bigint>")
    return let(clean, lambda t: F.when(t == "", none).otherwise(let(F.split(t, BLANKS), of)))


def sketch(text: Column, shingle: int = SHINGLE, scale: int = SCALE) -> Column:
    """Sorted kept hashes of a text's word shingles; no words keep none."""
    def kept(all_hashes: Column) -> Column:
        low = F.array_sort(F.array_distinct(F.filter(all_hashes, lambda x: x <= F.lit(limit(scale)))))
        least = F.slice(F.array_sort(all_hashes), 1, 1)
        return let(low, lambda k: F.when(F.size(k) > 0, k).otherwise(least))

    return let(shingle_hashes(text, shingle), kept)


def lone(least: Column, scale: int = SCALE) -> Column:
    """The least hash of a text if it is above the threshold, else NULL."""
    return F.when(least > F.lit(limit(scale)), least)


def digest(kept: Column) -> Column:
    """The sketch as text: 16 hex digits for each hash."""
    return F.array_join(F.transform(kept, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def containment(inner: Column, outer: Column) -> Column:
    """Estimated share of the first text's shingles that the second has; two empty sketches are alike."""
    shared = F.size(F.array_intersect(inner, outer)) / F.size(inner)
    return F.when(F.size(inner) > 0, shared).otherwise((F.size(outer) == 0).cast("double"))


def held(hash: Column, text: Column, shingle: int, share: Column) -> Column:
    """1 or 0 for a lone hash that is or is not among all hashes of the text; the share if it is NULL."""
    return F.when(hash.isNull(), share).otherwise(F.array_contains(shingle_hashes(text, shingle), hash).cast("double"))


def followed(rows: DataFrame, parts: int) -> DataFrame:
    """For distinct keys ``(doc_id, h)`` with ``half`` and ``lone``: the key before each and these two of it.

    The order is cut into ``parts`` ranges by Spark's range partitioner; inside a range a window finds
    the key before, and the first key of a range follows the last one of the range before (the very
    first follows the very last). Only one row per range crosses ranges.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("h").asc()]
    ranges = stored(rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()))
    inside = W.partitionBy("part").orderBy(*order)
    key = F.struct("doc_id", "h", "half", "lone")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "h", "half", "lone")
    last = ranges.groupBy("part").agg(F.max(place).alias("last"))
    across = W.orderBy("part")
    edges = last.select(
        "part", F.coalesce(F.lag("last").over(across), F.last("last").over(
            across.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("edge"))
    edge = F.struct("edge.doc_id", "edge.h", "edge.half", "edge.lone")
    lagged = ranges.withColumn("before", F.lag(key).over(inside)).join(F.broadcast(edges), "part")
    return lagged.select("doc_id", "h", F.coalesce("before", edge).alias("before"))


KEY = ["id", "known", "h"]


def keyed(doc_id: Column, h: Column, dtype) -> list[Column]:
    """The key of a document without NULL, so that joins and groups on it share one partitioning."""
    return [F.coalesce(doc_id, F.lit(0).cast(dtype)).alias("id"), doc_id.isNotNull().alias("known"), h.alias("h")]


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, scale: int = SCALE, rows_per_range: int = 50_000) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and the likeness to it and to the next text.

    The edited text has the last half of the code points replaced by the beginning of the next
    document in the order of doc_id (NULL first; equal ids by a hash of the text; rows equal in both
    count as one place in the order, and each gets the result). After the last comes the first; a
    single document is its own next one. NULL texts are empty. ``near_edited`` and ``near_next`` are
    the estimated share of the document's shingles that the other text has.

    Each text is shuffled once by its key, together with its sketch; what the document before needs of
    it, at most half of that document's length, is sent there in a second shuffle. Whether it has the
    lone hash of the document before is found where it stands, so no whole text is sent.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = documents.select("doc_id", text.alias("text"))
    length = F.length("text").cast("bigint")
    least = lone(F.array_min(shingle_hashes(F.col("text"), shingle)), scale)
    keys = base.select(
        "doc_id", F.xxhash64("text").alias("h"), F.floor(length / 2).alias("half"), least.alias("lone"))
    places = stored(keys.distinct())
    total = places.count()
    order = followed(places, max(1, min(4096, -(-total // rows_per_range))))

    dtype = base.schema["doc_id"].dataType
    own = keyed(F.col("doc_id"), F.xxhash64("text"), dtype)
    sketched = base.select(*own, "text", sketch(F.col("text"), shingle, scale).alias("kept"))
    earlier = order.select(
        *keyed(F.col("doc_id"), F.col("h"), dtype),
        F.struct(*keyed(F.col("before.doc_id"), F.col("before.h"), dtype)).alias("before"), "before.half",
        F.col("before.lone"))
    no_share = F.lit(None).cast("double")
    sent = sketched.join(earlier, KEY).select(
        "before.*", F.substring("text", F.lit(1), F.col("half").cast("int")).alias("head"),
        F.col("kept").alias("next_kept"), held(F.col("lone"), F.col("text"), shingle, no_share).alias("next_held"))
    sent = sent.groupBy(*KEY).agg(*[F.first(c).alias(c) for c in ("head", "next_kept", "next_held")])
    met = sketched.alias("d").join(sent.alias("s"), KEY, "left")
    n = F.length("d.text")
    edited = F.concat(F.substring("d.text", F.lit(1), (n - F.floor(n / 2)).cast("int")), F.col("s.head"))
    doc_id = F.when(F.col("known"), F.col("id")).alias("doc_id")
    rows = met.select(
        doc_id, n.cast("bigint").alias("n_chars"), "d.kept", "s.next_kept", "s.next_held", edited.alias("edited"))
    rows = rows.withColumn("edited_kept", sketch(F.col("edited"), shingle, scale))
    return rows.select(
        "doc_id", "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        digest(F.col("kept")).alias("fingerprint"),
        digest(F.col("edited_kept")).alias("edited_fingerprint"),
        held(lone(F.get("kept", F.lit(0)), scale), F.col("edited"), shingle, containment(F.col("kept"), F.col("edited_kept")))
        .alias("near_edited"),
        F.coalesce("next_held", containment(F.col("kept"), F.col("next_kept"))).alias("near_next"),
    )
