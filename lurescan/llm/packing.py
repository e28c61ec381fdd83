"""Packing documents into token sequences: shortest-pack-first over the length histogram."""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.text import longs, map_slices, once, stored

PIECE = T.ArrayType(
    T.StructType([
        T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ])
)

#: Fixed value: how byte-level BPE files split a text before merging (published pattern).
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The fast encoder looks back over a run of blanks with a call for each; longer runs take the file as is.
BLANK_RUN = 10_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoder(path: str):
    """``encode(text) -> ids``, equal to the tokenizer file's own result.

    A byte-level BPE file without normaliser whose ids follow its merge order is run through the faster
    rank-based encoder; other files, texts with one of the file's added tokens, and texts with a long run
    of blanks take the file as is.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = [t["content"] for t in spec.get("added_tokens", [])]
    ranks = merge_ranks(spec, set(added))

    def plain(text: str) -> list[int]:
        return whole.encode(text, add_special_tokens=False).ids

    if ranks is None:
        return plain
    import tiktoken

    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if any(t in text for t in added) or has_blank_run(text):
            return plain(text)
        return fast.encode_ordinary(text)

    return encode


def has_blank_run(text: str, limit: int = BLANK_RUN) -> bool:
    """Whether ``limit`` blanks of any kind follow one another."""
    if len(text) < limit:
        return False
    data = np.frombuffer(text.encode(), np.uint8)
    solid = np.flatnonzero((data > 32) & (data < 128))
    gaps = np.diff(solid, prepend=-1, append=len(data))
    return bool(gaps.max() > limit) and re.search(rf"\s{{{limit}}}", text) is not None


def merge_ranks(spec: dict, added: set[str]) -> dict[bytes, int] | None:
    """Bytes to id, if ids are merge ranks; None if the file is of another kind."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") or "BPE") != "BPE" or spec.get("normalizer") or split.get("type") != "ByteLevel":
        return None
    if split.get("add_prefix_space") or not split.get("use_regex", True) or model.get("ignore_merges"):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    ranks = {bytes(letters[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    made = [model["vocab"].get(a + b, -1) for a, b in pairs]
    singles = {bytes([b]) for b in range(256)}
    ordered = all(x < y for x, y in zip(made, made[1:]))
    return ranks if ordered and singles <= ranks.keys() and len(made) + 256 == len(ranks) else None


def pieces(
    documents: DataFrame, max_tokens: int = 2048, tokenizer: str | None = None, end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Token ids of each text and the end id, cut into pieces of at most ``max_tokens``.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, and with ``with_ids`` the ids. NULL and
    empty texts give the end id alone.
    """
    def work(buf, offsets, encode, part):
        raw, cut = buf.tobytes(), offsets.tolist()
        starts, lengths, crcs, tokens, sizes, values = [], [], [], [], [0], []
        for a, b in zip(cut, cut[1:]):
            ids = np.array([*encode(raw[a:b].decode(errors="replace")), end_id], dtype="<u4")
            for at in range(0, len(ids), max_tokens):
                piece = ids[at : at + max_tokens]
                starts.append(at)
                lengths.append(len(piece))
                crcs.append(zlib.crc32(piece.tobytes()))
                if with_ids:
                    values.append(piece)
            tokens.append(len(ids))
            sizes.append(len(starts))
        columns = {"start": longs(starts), "length": longs(lengths), "ids_crc32": longs(crcs)}
        if with_ids:
            flat = np.concatenate(values).astype(np.int32)
            ends = np.cumsum([0, *lengths]).astype(np.int32)
            columns["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
        rows = pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        return [longs(tokens), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), rows)]

    kind = PIECE
    if with_ids:
        kind = T.ArrayType(T.StructType([*PIECE.elementType.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))
    fields = [T.StructField("doc_tokens", T.LongType()), T.StructField("pieces", kind)]
    cut = map_slices(
        documents, "text", ["doc_id"], work, fields, prepare=lambda: once("encoder", tokenizer or default_tokenizer(), encoder))
    return cut.select("doc_id", "doc_tokens", F.explode("pieces").alias("p")).select("doc_id", "p.*", "doc_tokens")


def shortest_pack_first(histogram: dict[int, int], max_tokens: int) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: (length, first rank, end rank, first sequence, offset).

    Lengths are placed longest first, each into the shortest packs that exist, if they have room. Equal
    packs are one entry with a count: a run of sequence numbers. Placing a length splits an entry once
    at most, so the entries are bounded by the number of lengths, whatever the number of pieces.
    """
    packs: list[tuple[int, int, int]] = []  # tokens so far, first sequence, count
    places, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        grown = []
        while left and packs and packs[0][0] + length <= max_tokens:
            filled, first, count = heapq.heappop(packs)
            n = min(left, count)
            places.append((length, rank, rank + n, first, filled))
            grown.append((filled + length, first, n))
            if n < count:
                heapq.heappush(packs, (filled, first + n, count - n))
            rank, left = rank + n, left - n
            if not left or not packs or packs[0][0] + length > max_tokens:
                for entry in grown:
                    heapq.heappush(packs, entry)
                grown = []
        for entry in grown:
            heapq.heappush(packs, entry)
        if left:
            places.append((length, rank, rank + left, sequences, 0))
            heapq.heappush(packs, (length, sequences, left))
            sequences += left
    return places


def pack(
    documents: DataFrame, max_tokens: int = 2048, tokenizer: str | None = None, end_id: int = 1,
    with_ids: bool = False, rows_per_group: int = 5_000,
) -> DataFrame:
    """Every token of every row in exactly one piece, and each piece with its sequence and offset.

    The pieces are written once; only the histogram of lengths, ``max_tokens`` rows at most, reaches
    the driver. Pieces of one length are ranked in groups dealt by a hash of the piece's number, so a
    length that most pieces share is no single group. Repeated rows and NULL ids are packed like any
    other row; other columns are dropped; an empty table gives no pieces.
    """
    cut = stored(
        pieces(documents, max_tokens, tokenizer, end_id, with_ids).withColumn("piece", F.monotonically_increasing_id()))
    total = cut.count()
    groups = max(1, -(-total // rows_per_group))
    dealt = cut.withColumn("part", F.pmod(F.xxhash64("piece"), F.lit(groups)).cast("int"))
    counts = stored(dealt.groupBy("length", "part").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = shortest_pack_first(histogram, max_tokens)
    schema = "length bigint, low bigint, high bigint, first bigint, offset bigint"
    places = F.broadcast(cut.sparkSession.createDataFrame(places, schema))
    before = counts.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n"))
    own = F.row_number().over(W.partitionBy("length", "part").orderBy("piece")) - 1
    ranked = dealt.withColumn("own", own).join(before.drop("n"), ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    placed = ranked.join(places, "length").filter((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    ids = ["ids"] if with_ids else []
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *ids,
    )
