"""Whole texts as byte arrays inside Arrow batches, and small helpers around them."""

from __future__ import annotations

import ctypes
import sys
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.operators.tables import shared_folder

#: Text bytes that a task holds as arrays at a time; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 21

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_CODES = np.random.default_rng(2024).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def stored(df: DataFrame) -> DataFrame:
    """Write a table once into the shared folder and read it back, so that nothing above runs again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def once(kind: str, key, make: Callable):
    """``make(key)``, kept for later tasks of the same Python worker; one value of a kind is kept."""
    kept = sys.modules.setdefault("_lurescan_kept", types.ModuleType("_lurescan_kept")).__dict__
    if kind not in kept or kept[kind][0] != key:
        kept[kind] = (key, make(key))
    return kept[kind][1]


def map_slices(
    df: DataFrame, text: str, keep: list[str], work: Callable[..., list[pa.Array]], fields: list[T.StructField],
    prepare: Callable[[], object] | None = None,
) -> DataFrame:
    """Append columns computed from the text column, a bounded slice of rows at a time.

    ``prepare`` runs once per task; ``work(buf, offsets, prepared, batch)`` gets the UTF-8 bytes of a
    slice (NULL is empty), where each text begins, and the rows, and returns one array per new field.
    """
    chosen = df.select(*[F.col(c) for c in keep], F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(chosen.schema[c] for c in keep), *fields])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prepared = prepare() if prepare else None
        for batch in batches:
            for part in slices(batch):
                buf, offsets = as_bytes(part.column(part.num_columns - 1))
                made = work(buf, offsets, prepared, part)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*keep, *names])
        give_back()

    return chosen.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system: a Python worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the last column holds at most ``limit`` bytes, or one row."""
    if batch.num_rows == 0:
        return
    _, offsets = as_bytes(batch.column(batch.num_columns - 1))
    begin = 0
    while begin < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), batch.num_rows)
        yield batch.slice(begin, end - begin)
        begin = end


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array and the n+1 offsets into them; NULL is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf | 32, buf)


def word_bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end byte of each word, and for each text (and the end) its first word.

    A word is a run of bytes that are ``inside``; texts that touch are kept apart.
    """
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][np.diff(offsets) > 0]
    first[heads] = inside[heads]
    tails = heads[1:] - 1
    last[tails] = inside[tails]
    begins, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return begins, ends, np.searchsorted(begins, offsets)


def word_hashes(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash of each word's bytes, the same wherever the word stands."""
    out = np.zeros(len(begins), dtype=np.uint64)
    at = 0
    while at < len(begins):
        base = int(begins[at])
        to = max(at + 1, int(np.searchsorted(ends, base + block, "right")))
        span = int(ends[to - 1]) - base
        out[at:to] = _anchored(buf[base : base + span], begins[at:to] - base, ends[at:to] - base)
        at = to
    return out


def _powers(top: int) -> np.ndarray:
    powers = np.full(top + 1, _MULTIPLIER, dtype=np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def _anchored(buf: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    n = len(buf)
    top = max(1 << 20, n)
    powers = once("powers", top, _powers)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_BYTE_CODES[buf] * powers[:n], out=sums[1:])
    return mixed((sums[ends] - sums[begins]) * powers[top - begins] + (ends - begins).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def repeated_ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts [2, 0, 3]: owners [0, 0, 2, 2, 2] and places [0, 1, 0, 1, 2]."""
    owners = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owners, places


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, seed: int = 7
) -> DataFrame:
    """At most ``per_class`` labelled texts of each class, chosen by a hash of doc_id, with weights.

    Rows whose ``crc32(doc_id)`` modulo ``modulus`` is ``held`` never enter. ``weight`` is the share of
    the class that was left out, so that a model sees the class proportions of all labelled rows. A
    document with several labels counts as 1 if one of them is 1; one with several rows enters once.
    """
    kept = labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("id").isNotNull()
        & (F.crc32(F.col("id").cast("string").cast("binary")) % modulus != held)
    )
    kept = kept.groupBy("id").agg(F.max("label").alias("label"))
    order = F.xxhash64("id", F.lit(seed))
    picked = None
    for value in (0, 1):
        top = kept.filter(F.col("label") == value).orderBy(order, "id").limit(per_class)
        picked = top if picked is None else picked.unionByName(top)
    counts = kept.groupBy("label").agg(F.count("*").alias("n"))
    weights = counts.select("label", F.greatest(F.col("n") / per_class, F.lit(1.0)).alias("weight"))
    picked = picked.join(F.broadcast(weights), "label")
    texts = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    found = texts.join(F.broadcast(picked), "id")
    return found.groupBy("id", "label", "weight").agg(F.min("text").alias("text")).select("id", "label", "weight", "text")


def fit_in_one_task(sample: DataFrame, fit: Callable[[list], bytes]) -> bytes:
    """Train on a bounded sample inside one task and bring back the packed model.

    The rows are ordered by a hash first, so a rerun of the task gives the same model.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        rows.sort(key=lambda r: str(r.get("id")))
        np.random.default_rng(11).shuffle(rows)
        model = fit(rows)
        del rows
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    row = sample.coalesce(1).mapInArrow(run, "model binary").first()
    return bytes(row["model"]) if row is not None else fit([])


def doubles(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.float64), pa.float64())


def longs(values) -> pa.Array:
    return pa.array(np.asarray(values, dtype=np.int64), pa.int64())


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def prior_shift(rows: list[dict]) -> float:
    """What to add to a logit fitted on sampled classes so that it holds for all labelled rows.

    With one class only, or none, it pushes every score to that class, or to 0.
    """
    weight = {r["label"]: r["weight"] for r in rows}
    if len(weight) < 2:
        return 35.0 if 1 in weight else -35.0
    return float(np.log(weight[1]) - np.log(weight[0]))


def sample_slices(rows: list[dict], lower: bool = False, limit: int = SLICE_BYTES):
    """The texts of training rows as byte arrays: ``(buf, offsets, rows)`` in order."""
    part, size = [], 0
    for i, row in enumerate(rows):
        data = (row["text"] or "").lower() if lower else row["text"] or ""
        part.append((data.encode(), row))
        size += len(part[-1][0])
        if size >= limit or i + 1 == len(rows):
            offsets = np.cumsum([0, *(len(d) for d, _ in part)]).astype(np.int64)
            yield np.frombuffer(b"".join(d for d, _ in part), np.uint8), offsets, [r for _, r in part]
            part, size = [], 0
