"""SimHash near duplicates: fingerprints, multi-index hashing, components.

A fingerprint has two segments of 32 bits. If two fingerprints differ in at most two bits, either the
high segments differ in at most one bit or the low segments are equal. So the high table is searched
with a Hamming ball of radius one and the low table with the segment itself; each match is verified
over the complete 64 bits. Copies have one fingerprint, which enters once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.text import map_slices, stored

SEGMENT = 32
LOW_MASK = (1 << SEGMENT) - 1

#: Table buckets with more fingerprints are searched by the balls of the whole fingerprint instead.
BUCKET = 64


def fingerprint(data: bytes, shingle: int = 3) -> int:
    """Bit by bit majority of XXH64 over the word shingles of a text, repeats included.

    Words are what white space separates, A-Z lower-cased. Fewer words than a shingle: one shingle of
    all words; no words: zero.
    """
    words = data.lower().split()
    if not words:
        return 0
    text = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    size = min(shingle, len(words))
    count = len(words) - size + 1
    spans = zip(begins[:count].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for first in range(0, count, 1 << 16):
        part = [digest(text[a:b], 42) for (a, b), _ in zip(spans, range(first, min(count, first + (1 << 16))))]
        bits = np.unpackbits(np.array(part, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > count).tobytes(), "big")


def fingerprints(documents: DataFrame, shingle: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The fingerprint of each row as a signed 64-bit ``fp``; NULL and empty texts have zero."""
    def work(buf, offsets, _, part):
        raw = buf.tobytes()
        cut = offsets.tolist()
        made = [fingerprint(raw[a:b], shingle) for a, b in zip(cut, cut[1:])]
        return [pa.array(np.array(made, dtype=np.uint64).view(np.int64), pa.int64())]

    return map_slices(documents, "text", keep or ["doc_id"], work, [T.StructField("fp", T.LongType())])


def neighbours(prints: DataFrame, distance: int = 2, bucket: int = BUCKET) -> DataFrame:
    """Links ``(fp, other)`` that connect all distinct fingerprints within ``distance`` (at most 2) bits.

    Every pair within the distance is joined by a link or by links over a third value. A fingerprint in
    an overfull bucket, or searching one, takes the exact way of :func:`whole_balls`: no pair is listed
    there and the work stays proportional to the number of fingerprints.
    """
    if not 0 <= distance <= 2:
        raise ValueError("two segments with balls of radius one and zero reach a distance of at most 2")
    if distance == 0:
        return prints.select("fp", F.col("fp").alias("other")).limit(0)
    high, low = F.shiftrightunsigned("fp", SEGMENT), F.col("fp").bitwiseAND(F.lit(LOW_MASK))
    tables = prints.select(
        "fp", F.explode(F.array(
            F.struct(F.lit(0).alias("segment"), high.alias("value")),
            F.struct(F.lit(1).alias("segment"), low.alias("value")),
        )).alias("entry")
    ).select("fp", "entry.segment", "entry.value")
    sizes = tables.groupBy("segment", "value").agg(F.count("*").alias("n"))
    overfull = stored(sizes.filter(F.col("n") > bucket).select("segment", "value"))

    # each pair is met once: of two values that differ in one bit, the one with a zero there probes
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))
    places = F.sequence(F.lit(0), F.lit(SEGMENT - 1))
    raised = F.transform(
        F.filter(places, lambda i: high.bitwiseAND(bit(i)) == 0),
        lambda i: F.struct(F.lit(0).alias("segment"), high.bitwiseOR(bit(i)).alias("value")),
    )
    probes = prints.select("fp", F.explode(raised).alias("entry")).select("fp", "entry.segment", "entry.value")
    probes = probes.withColumn("apart", F.lit(1)).unionByName(tables.withColumn("apart", F.lit(0)))

    hot = probes.join(overfull, ["segment", "value"], "left_semi").select("fp").distinct()
    usual = tables.join(overfull, ["segment", "value"], "left_anti").withColumnRenamed("fp", "other")
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance
    met = probes.join(usual, ["segment", "value"]).filter(
        ((F.col("apart") == 1) | (F.col("fp") < F.col("other"))) & close
    )
    return met.select("fp", "other").unionByName(whole_balls(hot, distance))


def whole_balls(prints: DataFrame, distance: int) -> DataFrame:
    """Links among fingerprints of overfull buckets.

    Each value enumerates the ball of radius one around itself; two values are within two bits exactly
    if their balls share a point. A point links its visitors to the smallest of them, which is verified
    to be within the distance; for distance one the point has to be one of the values.
    """
    flips = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))),
    )
    visits = prints.select("fp", F.explode(F.concat(F.array("fp"), flips)).alias("point"))
    centre = visits.groupBy("point").agg(
        F.min("fp").alias("least"), F.max("fp").alias("most"), F.max(F.col("fp") == F.col("point")).alias("own")
    )
    shared = centre.filter(F.col("least") < F.col("most"))
    if distance == 1:
        links = visits.join(shared.filter("own"), "point").select("fp", F.col("point").alias("other"))
        return links.filter("fp <> other")
    links = visits.join(shared, "point").filter("fp <> least")
    links = links.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= distance)
    return links.select("fp", F.col("least").alias("other"))


def components(links: DataFrame, rank: DataFrame) -> DataFrame:
    """``(fp, label, root)`` for every fingerprint with a link.

    The label is the smallest rank it can reach, the root a fingerprint that names its component.
    ``rank`` holds ``(fp, least)``. Rounds of alternating stars: each vertex hands the smallest label
    of its neighbourhood to its larger neighbours, then to its smaller ones. Paths halve in each round;
    the tables of a round are written to the shared folder, so a lost executor costs one round.
    """
    both = links.select(F.col("fp").alias("u"), F.col("other").alias("v"))
    edges = stored(both.filter("u <> v").distinct())
    if edges.isEmpty():
        none = rank.select("fp", F.col("least").alias("label"), F.col("fp").alias("root"))
        return none.limit(0)
    roots = None
    while True:
        flat = star(edges, larger=True)
        flat = star(flat, larger=False)
        after = stored(flat)
        # a forest of stars is reached once no vertex is both a child and a parent
        parents = after.select(F.col("v").alias("u")).distinct()
        if after.join(parents, "u", "left_semi").isEmpty() and after.groupBy("u").agg(
            F.count("*").alias("n")).filter("n > 1").isEmpty():
            roots = after
            break
        edges = after
    members = roots.select(F.col("u").alias("fp"), F.col("v").alias("root"))
    members = members.unionByName(roots.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    named = members.join(rank, "fp")
    least = named.groupBy("root").agg(F.min("least").alias("label"))
    return members.join(least, "root").select("fp", "label", "root")


def star(edges: DataFrame, larger: bool) -> DataFrame:
    """One half round on edges (u, v): u's neighbours move to the least vertex around u.

    ``larger``: only neighbours above u move (and u counts among the candidates); otherwise u and its
    smaller neighbours move. The result has u > v, without repeats. The groups are aggregated before
    they are joined back, so that a vertex with many neighbours is never collected.
    """
    if larger:
        around = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = around.join(least, "u")
    if larger:
        moved = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        own = least.select("u", F.col("m").alias("v"))
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(own)
    return moved.filter("u > v").distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """Per row: doc_id, fingerprint as 16 hex digits and the smallest doc_id of its component.

    NULL, empty and blank texts have the zero fingerprint and are linked like any other. Repeated rows
    come out as often as they come in; other columns are dropped. A NULL doc_id never names a component
    that holds another id.
    """
    rows = stored(fingerprints(documents, shingle))
    return labelled(rows, distance).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def labelled(rows: DataFrame, distance: int) -> DataFrame:
    """Add component_id and root to rows with ``doc_id`` and ``fp``; ``rows`` is read several times."""
    rank = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    links = neighbours(rank.select("fp"), distance)
    found = components(links, rank)
    # stored, so that the join below has a shuffle of its own and a group of copies can be split there
    names = stored(rank.join(found, "fp", "left").select(
        "fp", F.coalesce("label", "least").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return rows.join(names, "fp", "left")


def without_copies(documents: DataFrame, shingle: int = 3, distance: int = 2) -> DataFrame:
    """One document of each component stays: the one with the smallest doc_id, all columns kept.

    Of rows that repeat this doc_id one stays, the first by a hash of its text; a NULL doc_id comes last.
    """
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("__id"), F.xxhash64("text").alias("__h")]
    packed = documents.select(F.struct("doc_id", *key).alias("key"), "text")
    prints = stored(fingerprints(packed, shingle, keep=["key"]).select("fp", "key.*"))
    groups = labelled(prints, distance)
    # the row to keep is found on narrow rows before the texts are read again
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__h", "__id")
    first = groups.groupBy("root").agg(F.min(order).alias("k"))
    chosen = first.select("k.__id", "k.__h").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    kept = documents.select(row, *key).join(chosen, ["__id", "__h"], "left_semi").dropDuplicates(["__id", "__h"])
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
