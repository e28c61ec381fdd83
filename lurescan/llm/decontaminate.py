"""Benchmark passages inside documents: Wu-Manber search over words.

The alphabet is the words of a text and a block is two neighbouring words. A shift table over blocks
says how far a window can move on without skipping an occurrence; blocks with shift zero lead to a
bucket of the patterns that end with them; a direct comparison of the bytes confirms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.text import longs, lower_ascii, map_slices, mixed, repeated_ranges, word_bounds, word_hashes

#: Words of a search position at a time; longer texts are cut into lanes that overlap.
LANE_WORDS = 1024
TABLE_BITS = 18

#: Text of the items that are compiled at a time.
BLOCK_BYTES = 1 << 24

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hit_words", T.ArrayType(T.LongType())),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def word_bytes(buf: np.ndarray) -> np.ndarray:
    """Whether a byte of a lower-cased text belongs to a word: digits, a-z, anything not ASCII."""
    return ((buf >= 48) & (buf <= 57)) | ((buf >= 97) & (buf <= 122)) | (buf >= 128)


def words_of(buf: np.ndarray, offsets: np.ndarray):
    low = lower_ascii(buf)
    begins, ends, first = word_bounds(word_bytes(low), offsets)
    return low, begins, ends, first, word_hashes(low, begins, ends)


class Patterns:
    """Shift table and suffix buckets for the windows of one length."""

    def __init__(self, hashes: np.ndarray, texts: list[bytes], items: list[list[str]]):
        self.hashes, self.texts, self.items = hashes, texts, items
        self.length = hashes.shape[1]
        self.block = min(2, self.length)
        blocks = blocks_of(hashes, self.block)
        self.furthest = blocks.shape[1]
        self.shift = np.full(1 << TABLE_BITS, self.furthest, dtype=np.int64)
        for place in range(blocks.shape[1]):
            np.minimum.at(self.shift, slot(blocks[:, place]), blocks.shape[1] - 1 - place)
        order = np.argsort(blocks[:, -1], kind="stable")
        self.bucket_keys, starts = np.unique(blocks[order, -1], return_index=True)
        self.bucket_starts = np.append(starts, len(order))
        self.members = order

    def positions(self, blocks: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """Last-block positions whose shift is zero; lane i searches ``lows[i] <= p < highs[i]``."""
        found, at, end = [], lows, highs
        while len(at):
            live = at < end
            at, end = at[live], end[live]
            step = self.shift[slot(blocks[at])]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def occurrences(self, hashes: np.ndarray, firsts: np.ndarray, same) -> Iterator[tuple[int, int]]:
        """(first word, pattern) of every occurrence inside the texts that begin at ``firsts``."""
        if len(hashes) < self.length:
            return
        blocks = blocks_of(hashes[None, :], self.block)[0]
        lead = self.length - self.block
        lows, highs = firsts[:-1] + lead, firsts[1:] - self.block + 1
        lanes = np.maximum(0, -(-(highs - lows) // LANE_WORDS))
        owner, part = repeated_ranges(lanes)
        low = lows[owner] + part * LANE_WORDS
        at = self.positions(blocks, low, np.minimum(low + LANE_WORDS, highs[owner]))
        key = np.searchsorted(self.bucket_keys, blocks[at])
        known = key < len(self.bucket_keys)
        known[known] = self.bucket_keys[key[known]] == blocks[at[known]]
        at, key = at[known], key[known]
        which, place = repeated_ranges(self.bucket_starts[key + 1] - self.bucket_starts[key])
        pattern = self.members[self.bucket_starts[key[which]] + place]
        begin = at[which] - lead
        for offset in range(self.length):
            equal = hashes[begin + offset] == self.hashes[pattern, offset]
            begin, pattern = begin[equal], pattern[equal]
        for b, p in zip(begin.tolist(), pattern.tolist()):
            if same(b, self.length) == self.texts[p]:
                yield b, p


def blocks_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return hashes if size == 1 else mixed(hashes[:, :-1] * np.uint64(31) + hashes[:, 1:])


def slot(blocks: np.ndarray) -> np.ndarray:
    return (blocks >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def compile_patterns(rows: list[tuple[str, str]], window: int) -> list[Patterns]:
    """Distinct windows of the items, grouped by their number of words."""
    buf = np.frombuffer("\n".join(t for _, t in rows).encode() + b"\n", dtype=np.uint8)
    sizes = [len(t.encode()) + 1 for _, t in rows]
    low, begins, ends, first, hashes = words_of(buf, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
    raw = low.tobytes()
    owners: dict[bytes, set[str | None]] = {}
    place: dict[bytes, tuple[int, int]] = {}
    for i, (item, _) in enumerate(rows):
        f, to = int(first[i]), int(first[i + 1])
        size = min(window, to - f)
        for at in range(f, to - size + 1 if size else f):
            text = b" ".join(raw[begins[k] : ends[k]] for k in range(at, at + size))
            owners.setdefault(text, set()).add(item)
            place.setdefault(text, (at, size))
    groups: dict[int, list[bytes]] = {}
    for text, (_, size) in place.items():
        groups.setdefault(size, []).append(text)
    return [
        Patterns(
            np.stack([hashes[place[t][0] : place[t][0] + size] for t in texts]), texts, [sorted(owners[t] - {None}) for t in texts]
        )
        for size, texts in sorted(groups.items())
    ]


def matches(documents: DataFrame, benchmark: DataFrame, window: int = 10, block_items: int = 20_000) -> DataFrame:
    """Per document: its words, the words that a benchmark window covers, and the items found.

    Texts are lower-cased (A-Z) and cut into words; a window is ``window`` consecutive words of an item,
    or the whole item if it is shorter. ``block_items`` items are compiled at a time, so that what a
    task holds has a bound; further blocks follow in the same pass over the rows and nothing is
    shuffled. NULL or empty texts and items have no words; items without words are never found; an item
    without id hits words like any other, but has no name to be listed under; repeated items are found under
    each id; rows repeat as they come; other columns are dropped.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    items = items.filter(F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    blocks = max(1, -(-size["n"] // block_items), -(-size["size"] // BLOCK_BYTES))
    number = F.pmod(F.xxhash64("item", "text"), F.lit(blocks))
    out = documents.select("doc_id", "text")
    for k in range(blocks):
        rows = [(r["item"], r["text"]) for r in items.filter(number == k).collect()]
        earlier = [] if k == 0 else ["earlier_words", "earlier_items"]
        out = one_block(out, rows, window, ["doc_id", *(["text"] if k + 1 < blocks else []), *earlier])
        if earlier:
            out = out.withColumn("hit_words", F.array_union("earlier_words", "hit_words"))
            out = out.withColumn("items", F.array_union("earlier_items", "items")).drop(*earlier)
        if k + 1 < blocks:
            out = out.drop("n_words").withColumnsRenamed({"hit_words": "earlier_words", "items": "earlier_items"})
    return out.select("doc_id", "n_words", "hit_words", "items")


def one_block(df: DataFrame, rows: list[tuple[str, str]], window: int, keep: list[str]) -> DataFrame:
    def work(buf, offsets, patterns, part):
        low, begins, ends, first, hashes = words_of(buf, offsets)
        raw = low.tobytes()

        def same(at: int, length: int) -> bytes:
            return b" ".join(raw[begins[k] : ends[k]] for k in range(at, at + length))

        covered = np.zeros(len(begins) + 1, np.int64)
        items: dict[int, set[str]] = {}
        for group in patterns:
            for at, pattern in group.occurrences(hashes, first, same):
                covered[at] += 1
                covered[at + group.length] -= 1
                doc = int(np.searchsorted(first, at, "right")) - 1
                items.setdefault(doc, set()).update(group.items[pattern])
        hit = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
        at = np.searchsorted(hit, first)
        owner = np.repeat(np.arange(len(first) - 1), np.diff(at))
        hit_lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), longs(hit - first[owner]))
        names = pa.array([sorted(items.get(i, ())) for i in range(len(first) - 1)], pa.list_(pa.string()))
        return [longs(np.diff(first)), hit_lists, names]

    return map_slices(df, "text", keep, work, FIELDS, prepare=lambda: compile_patterns(rows, window) if rows else [])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256 and whether any word is hit."""
    found = matches(documents, benchmark, window)
    return found.select(
        "doc_id",
        "n_words",
        F.size("hit_words").cast("bigint").alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hit_words") > 0).alias("contaminated"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Documents without the contaminated ones, all their columns kept.

    The search runs on the text column only; a document is dropped when one of its words is hit, by an item
    without id as well. NULL and empty texts stay, and repeated rows stay or go together.
    """
    columns = documents.columns
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    packed = documents.select(row.alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = matches(packed, benchmark, window).filter(F.size("hit_words") == 0)
    return found.select(*[F.col("doc_id").getField(c).alias(c) for c in columns])


def oracle_sql(window: int = 10) -> str:
    """The same rows in SQL: every window of every length is joined as text."""
    words = (
        "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        "'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    )
    return f"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, {words} AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {words} AS w FROM benchmark
), item_window AS (
  SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT item, w, least({window}, len(w)) AS k, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)
), place AS (
  SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS x
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM item_window) WHERE len(w) >= k)
), hit AS (
  SELECT r, place.k, i, item FROM place JOIN item_window ON place.x = item_window.x AND place.k = item_window.k
), covered AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r
), found AS (
  SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list_distinct(list(item))), ',') AS items
  FROM hit GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN found USING (r)
"""
