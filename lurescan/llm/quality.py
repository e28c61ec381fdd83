"""Quality scores: a byte-level convolutional network in numpy.

A text is cut into chunks of 256 bytes that overlap by half and cover it whole. Learned filters over
six bytes are max-pooled in each chunk, a hidden layer scores the chunk, and the mean of the chunk
scores is the logit of the text.
"""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.llm.text import (
    doubles, fit_in_one_task, labelled_sample, map_slices, prior_shift, repeated_ranges, sample_slices, sigmoid,
)

WIDTH, FILTERS, HIDDEN, HALF = 6, 32, 12, 128

#: Labelled texts of each class that the network is fitted on at most.
SAMPLE_PER_CLASS = 2_500

#: A small sample is passed more often than a large one, until so many steps are done.
BATCH_BYTES, STEPS, EPOCHS, RATE = 48_000, 900, (4, 40), 0.01

#: Halves of a chunk that are convolved at a time, so that their responses stay in the cache.
BLOCK = 64


def halves(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each half chunk with the bytes its last windows need, zero beyond the text; and the
    first half of each text. An empty text has one half of zeros."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // HALF))
    owner, place = repeated_ranges(counts)
    begin = offsets[owner] + place * HALF
    at = begin[:, None] + np.arange(HALF + WIDTH - 1)
    inside = at < offsets[owner + 1][:, None]
    grid = np.zeros(at.shape, np.uint8)
    grid[inside] = buf[at[inside]]
    return grid, np.concatenate([[0], np.cumsum(counts)])


def chunk_pairs(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Left and right half of each chunk and the owner text; a text with one half is one chunk."""
    counts = np.diff(first)
    owner, place = repeated_ranges(np.maximum(1, counts - 1))
    left = first[owner] + place
    return left, np.minimum(left + 1, first[owner + 1] - 1), owner


class Network:
    """Filters as weights of (place, byte), then a hidden layer per chunk."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.w = {
            "filters": rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
            "floor": np.zeros(FILTERS, np.float32),
            "hidden": rng.normal(0, 0.3, (FILTERS, HIDDEN)).astype(np.float32),
            "shift": np.zeros(HIDDEN, np.float32),
            "out": rng.normal(0, 0.3, HIDDEN).astype(np.float32),
            "bias": np.zeros(1, np.float32),
        }

    def pairs(self) -> list[np.ndarray]:
        """One table per two neighbouring places, indexed by both bytes."""
        f = self.w["filters"]
        return [(f[j][:, None, :] + f[j + 1][None, :, :]).reshape(65536, FILTERS) for j in range(0, WIDTH, 2)]

    def chunk_scores(self, pooled: np.ndarray) -> np.ndarray:
        a = np.maximum(pooled + self.w["floor"], 0).astype(np.float64)  # so that a score hardly depends on its batch
        return np.tanh(a @ self.w["hidden"] + self.w["shift"]) @ self.w["out"] + self.w["bias"][0]

    def logits(self, buf: np.ndarray, offsets: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        grid, first = halves(buf, offsets)
        best = np.empty((len(grid), FILTERS), np.float32)
        out = np.empty((BLOCK * HALF, FILTERS), np.float32)
        more = np.empty_like(out)
        for at in range(0, len(grid), BLOCK):
            part = grid[at : at + BLOCK].astype(np.intp)
            n = len(part) * HALF
            for j, weights in enumerate(tables):
                code = part[:, 2 * j : 2 * j + HALF] * 256 + part[:, 2 * j + 1 : 2 * j + 1 + HALF]
                np.take(weights, code.ravel(), axis=0, out=out[:n] if j == 0 else more[:n], mode="clip")
                if j:
                    out[:n] += more[:n]
            best[at : at + BLOCK] = out[:n].reshape(len(part), HALF, FILTERS).max(axis=1)
        left, right, owner = chunk_pairs(first)
        scores = self.chunk_scores(np.maximum(best[left], best[right]))
        return np.bincount(owner, scores, len(first) - 1) / np.bincount(owner, minlength=len(first) - 1)

    def gradients(self, buf: np.ndarray, offsets: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        grid, first = halves(buf, offsets)
        response = np.zeros((len(grid), HALF, FILTERS), np.float32)
        for j in range(WIDTH):
            response += w["filters"][j][grid[:, j : j + HALF]]
        peak = response.argmax(axis=1)
        best = np.take_along_axis(response, peak[:, None, :], 1)[:, 0]
        left, right, owner = chunk_pairs(first)
        from_left = best[left] >= best[right]
        pooled = np.where(from_left, best[left], best[right])
        a = np.maximum(pooled + w["floor"], 0)
        t = np.tanh(a @ w["hidden"] + w["shift"])
        counts = np.bincount(owner, minlength=len(labels))
        logit = np.bincount(owner, t @ w["out"] + w["bias"][0], len(labels)) / counts
        d = ((sigmoid(logit) - labels) / counts / len(labels))[owner].astype(np.float32)
        dt = d[:, None] * w["out"] * (1 - t * t)
        da = (dt @ w["hidden"].T) * (a > 0)
        grads = {
            "out": t.T @ d, "bias": d.sum(keepdims=True), "hidden": a.T @ dt, "shift": dt.sum(0), "floor": da.sum(0),
        }
        half = np.where(from_left, left[:, None], right[:, None])
        spot = peak[half, np.arange(FILTERS)]
        dfilter = np.zeros_like(w["filters"])
        moved = da != 0
        kind = np.broadcast_to(np.arange(FILTERS), da.shape)[moved]
        half, spot, value = half[moved], spot[moved], da[moved]
        for j in range(WIDTH):
            np.add.at(dfilter[j], (grid[half, spot + j], kind), value)
        grads["filters"] = dfilter
        return grads


def fit(rows: list[dict]) -> bytes:
    """Adam over small groups of whole texts, in an order that each epoch deals anew."""
    net, rng = Network(), np.random.default_rng(3)
    first = {k: np.zeros_like(v) for k, v in net.w.items()}
    second = {k: np.zeros_like(v) for k, v in net.w.items()}
    step = 0
    groups = max(1, sum(len((r["text"] or "").encode()) for r in rows) // BATCH_BYTES)
    epochs = int(np.clip(-(-STEPS // groups), *EPOCHS)) if len({r["label"] for r in rows}) > 1 else 0
    for epoch in range(epochs):
        order = [rows[i] for i in rng.permutation(len(rows))]
        rate = RATE * (1 - epoch / (epochs + 1))
        for buf, offsets, part in sample_slices(order, limit=BATCH_BYTES):
            grads = net.gradients(buf, offsets, np.array([r["label"] for r in part], np.float32))
            step += 1
            for k, g in grads.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7
                net.w[k] -= (rate * first[k] / (1 - 0.9**step) / scale).astype(np.float32)
    out = io.BytesIO()
    np.savez_compressed(out, prior=prior_shift(rows), **net.w)
    return out.getvalue()


def unpack(model: bytes) -> tuple[Network, list[np.ndarray], float]:
    parts = np.load(io.BytesIO(model))
    net = Network()
    net.w = {k: parts[k] for k in net.w}
    return net, net.pairs(), float(parts["prior"])


def score(documents: DataFrame, model: bytes, keep: list[str] | None = None) -> DataFrame:
    """``score`` for each whole text; NULL is empty, and empty texts are scored like a chunk of zeros.

    The network has a fixed size, so what each task receives has a bound.
    """
    def work(buf, offsets, prepared, part):
        net, tables, prior = prepared
        return [doubles(np.round(sigmoid(net.logits(buf, offsets, tables) + prior), 9))]

    return map_slices(
        documents, "text", keep or ["doc_id"], work, [T.StructField("score", T.DoubleType())],
        prepare=lambda: unpack(model))


def train(documents: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS) -> bytes:
    """Fit on a bounded sample of the labelled rows that are not held out (crc32 modulo 5 is 0)."""
    return fit_in_one_task(labelled_sample(documents, labels, "quality", 5, 0, per_class), fit)


def quality(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted.

    Repeated rows are scored alike and each kept; a NULL doc_id is never held out; without any label
    every score is 0. Other columns are dropped.
    """
    scored = score(documents, train(documents, labels))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good_documents(documents: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Documents that the classifier does not reject, all columns kept.

    NULL and empty texts are scored as empty ones; equal texts stay or go together, repeated rows each; rows
    without doc_id are scored like any other.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    packed = documents.select(row.alias("row"), F.col("text").cast("string").alias("text"))
    kept = score(packed, train(documents, labels), keep=["row"]).filter(F.col("score") >= threshold)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in documents.columns])
