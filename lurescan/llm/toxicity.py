"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.decontaminate import word_bytes
from lurescan.llm.text import (
    doubles, fit_in_one_task, labelled_sample, map_slices, mixed, prior_shift, sample_slices, sigmoid, word_bounds,
    word_hashes,
)

BITS = 20

#: Distances between the two words of a pair: 1 is a bigram, more are skip-grams.
GAPS = (1, 2, 3)

#: Bytes at the head of a word that stand for it as a stem, so that unseen endings are met.
STEMS = (4, 6)

#: Labelled texts of each class that the model is fitted on at most.
SAMPLE_PER_CLASS = 6_000

ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 2.0, 0.0, 3


def features(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owner text and hashed index of every word, stem, neighbouring pair and pair with words between."""
    begins, ends, first = word_bounds(word_bytes(buf), offsets)
    h = word_hashes(buf, begins, ends)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    owners, codes = [owner], [mixed(h)]
    for stem in STEMS:
        owners.append(owner)
        codes.append(mixed(word_hashes(buf, begins, np.minimum(ends, begins + stem)) + np.uint64(stem)))
    for gap in GAPS:
        same = owner[gap:] == owner[:-gap] if len(owner) > gap else np.zeros(0, bool)
        left, right = h[: len(same)][same], h[gap:][same]
        owners.append(owner[: len(same)][same])
        codes.append(mixed(left * np.uint64(2 * gap + 1) + right * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(owners), (np.concatenate(codes) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows: list[dict]) -> bytes:
    """Weights by FTRL-proximal, one text at a time; packed as their sparse form."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    texts = []
    for buf, offsets, part in sample_slices(rows, lower=True):
        owner, index = features(buf, offsets)
        pairs = np.unique((owner << BITS) | index)
        owner, index = pairs >> BITS, pairs & (size - 1)
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        texts += [(index[a:b].astype(np.int32), r["label"]) for a, b, r in zip(cut, cut[1:], part)]
    shift = prior_shift(rows)

    def weights(zi, ni):
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(ni)) / ALPHA + L2)

    for _ in range(PASSES):
        for index, label in texts:
            zi, ni = z[index], n[index]
            w = weights(zi, ni)
            bias = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
            g = sigmoid(w.sum() + bias) - label
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[index] = ni + g * g
            z[size] += g - (np.sqrt(n[size] + g * g) - np.sqrt(n[size])) / ALPHA * bias
            n[size] += g * g
    w = weights(z[:size], n[:size])
    index = np.flatnonzero(w)
    bias = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
    out = io.BytesIO()
    np.savez_compressed(out, index=index.astype(np.uint32), weight=w[index].astype(np.float32), bias=bias + shift)
    return out.getvalue()


def unpack(model: bytes) -> tuple[np.ndarray, float]:
    parts = np.load(io.BytesIO(model))
    dense = np.zeros(1 << BITS, np.float32)
    dense[parts["index"]] = parts["weight"]
    return dense, float(parts["bias"])


def score(documents: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """``score`` for each whole text; NULL and empty texts get the share of the label in training.

    The model is a sparse vector of at most 2^20 weights, so what each task receives has a bound.
    """
    def work(buf, offsets, prepared, part):
        dense, bias = prepared
        owner, index = features(buf, offsets)
        weight = dense[index]
        used = np.flatnonzero(weight)
        pairs = np.unique((owner[used] << BITS) | index[used])
        total = np.bincount(pairs >> BITS, dense[pairs & ((1 << BITS) - 1)], minlength=len(offsets) - 1)
        return [doubles(np.round(sigmoid(total + bias), 9))]

    lowered = documents.withColumn("text", F.lower(F.col("text").cast("string")))
    return map_slices(
        lowered, "text", keep or ["doc_id"], work, [T.StructField("score", T.DoubleType())],
        prepare=lambda: unpack(model))


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> bytes:
    """Fit on a bounded sample of the labelled rows that are not held out (crc32 modulo 4 is 2)."""
    return fit_in_one_task(labelled_sample(documents, labels, "toxic", 4, 2, per_class), fit)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Repeated rows are scored alike and each kept; a NULL doc_id is never held out; without any label
    every score is 0. Other columns are dropped.
    """
    scored = score(documents, train(documents, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
