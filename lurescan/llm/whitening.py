"""Whitening of embeddings along their leading components, found by spectrum slicing.

The vectors become whole numbers, so sums and the covariance are exact and no order of tasks shows. The
covariance of the distinct vectors, one small matrix, is sliced: the inertia of its LDL^T factors, shifted,
counts the eigenvalues above the shift; bisection isolates the k-th largest; Rayleigh quotient iteration
converges to it; and two more counts certify that it is the k-th. The vectors themselves stay in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm.text import doubles, longs, stored

SCALE = 256
COMPONENTS = 4

#: Vectors that a task works on at a time.
ROWS = 4096

_HALF = 1 << 60
_EPS = np.finfo(np.float64).eps


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` per row and component.

    Rows whose vector is NULL or holds NULL, NaN or infinity are left out. An entry c becomes
    floor(256 c), at the end of the range of a long if it lies beyond. A vector shorter than the longest
    counts as 0 where it ends, so an empty one is zero. Repeated rows and repeated or NULL ids stay; the
    fit has each distinct vector once. ``deviation`` is NULL where it exceeds a long. There are at most as
    many components as dimensions; one without variance has NULL for ``whitened`` and does not count for
    ``identity_error`` (NULL if none has any), and ``explained`` is NULL if there is no variance at all.
    No rows give no rows.
    """
    rows, dims, width = _whole_numbers(embeddings)
    if dims is None:
        return rows.sparkSession.createDataFrame([], _SCHEMA)
    fit = stored(rows.select("x").distinct())
    model = Model(fit, dims, width, components)
    model.identity_error = _identity_error(fit, model)
    return rows.mapInArrow(model.applied, _SCHEMA)


_SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def _whole_numbers(embeddings: DataFrame) -> tuple[DataFrame, int | None, int]:
    """``vec_id, x``: the vectors as whole numbers of 2, 4 or 8 bytes, as many as the longest vector has."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    entries = F.transform(F.col("embedding"), lambda c: F.floor(c.cast("double") * SCALE))
    kept = embeddings.filter(F.col("embedding").isNotNull() & F.forall("embedding", finite)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), entries.alias("x"))
    top = kept.agg(F.max(F.size("x")), F.max(F.array_max("x")), F.min(F.array_min("x"))).first()
    dims, high, low = top[0], top[1] or 0, top[2] or 0
    width = next(w for w in (2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.flatten().to_numpy()
            x = np.zeros((batch.num_rows, dims), f"<i{width}")
            x[np.arange(dims) < sizes[:, None]] = values
            body = x.tobytes()
            step = dims * width
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([body[i * step : (i + 1) * step] for i in range(len(x))], pa.binary())],
                names=["vec_id", "x"])

    return (kept if dims is None else kept.mapInArrow(pack, "vec_id bigint, x binary")), dims, width


def _vectors(batch: pa.RecordBatch, column: int, dims: int, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a batch: the first row, and the vectors as 64-bit numbers."""
    for begin in range(0, batch.num_rows, ROWS):
        part = batch.column(column).slice(begin, ROWS).to_pylist()
        x = np.frombuffer(b"".join(part), f"<i{width}").astype(np.int64)
        yield begin, x.reshape(len(part), dims)


def _totals(fit: DataFrame, dims: int, width: int, size: int, work: Callable[[np.ndarray], np.ndarray]) -> list[int]:
    """Exact sums over all vectors of what ``work`` gives for some of them, ``size`` whole numbers."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for _, x in _vectors(batch, 0, dims, width):
                made = work(x)
                total = made if total is None else total + made
        if total is not None:
            parts = [divmod(int(t), _HALF) for t in total]
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.arange(size, dtype=np.int32)),
                pa.array([h for h, _ in parts], kind), pa.array([low for _, low in parts], kind)], names=["place", "high", "low"])

    sums = fit.mapInArrow(add, "place int, high decimal(38,0), low decimal(38,0)").groupBy("place").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * size
    for r in sums.collect():  # one row per entry of the matrix
        out[r["place"]] = int(r["high"]) * _HALF + int(r["low"])
    return out


def _summed(x: np.ndarray) -> np.ndarray:
    """Sums of each dimension, the last one the number of vectors, as unbounded numbers."""
    top = max(1, int(np.abs(x.astype(np.float64)).max(initial=0)) + 1)
    sums = x.sum(axis=0).astype(object) if top * len(x) < 1 << 62 else x.astype(object).sum(axis=0)
    return np.append(sums, len(x))


def _products(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """Sums of the products of all pairs of centred dimensions, exact.

    Products are added as doubles while no sum can pass 2**53.
    """
    low, high = x.min(axis=0), x.max(axis=0)
    top = max(max(abs(int(a) - c), abs(int(b) - c)) for a, b, c in zip(low, high, centre)) if x.size else 0
    lower = np.tril_indices(x.shape[1])
    step = (1 << 53) // max(1, top * top)
    if step == 0:
        y = x.astype(object) - np.array(centre, object)
        return (y.T @ y)[lower]
    y = (x - np.array(centre, np.int64)).astype(np.float64)
    total = np.zeros(len(lower[0]), object)
    for begin in range(0, len(y), step):
        part = y[begin : begin + step]
        total = total + (part.T @ part)[lower].astype(np.int64)
    return total


class Model:
    """Mean, covariance and leading components of the fit list."""

    def __init__(self, fit: DataFrame, dims: int, width: int, components: int):
        self.dims, self.width = dims, width
        *sums, self.n = _totals(fit, dims, width, dims + 1, _summed)
        n = self.n
        # whole numbers next to the means, and what is left of the sums
        self.centre = centre = [(2 * s + n) // (2 * n) for s in sums]
        self.rest = [s - n * c for s, c in zip(sums, centre)]
        products = _totals(fit, dims, width, dims * (dims + 1) // 2, lambda x: _products(x, centre))
        v = np.zeros((dims, dims))
        for p, i, j in zip(products, *np.tril_indices(dims)):
            v[i, j] = v[j, i] = (p * n - self.rest[i] * self.rest[j]) / (n * n)
        self.covariance = v
        self.trace = float(np.trace(v))
        pairs = leading(v, min(components, dims))
        self.values = [e for e, _ in pairs]
        floor = 8 * dims * _EPS * max(self.values, default=0.0)
        self.live = [e > floor for e in self.values]
        self.axes = np.array([u / math.sqrt(e) if ok else 0 * u for (e, u), ok in zip(pairs, self.live)]).reshape(len(pairs), dims).T
        self.shift = np.array([r / n for r in self.rest])
        self.identity_error: float | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        """Centred vectors along the components, each divided by its deviation."""
        if self.width == 8:  # entries may lie further apart than a long holds
            y = (x.astype(object) - np.array(self.centre, object)).astype(np.float64)
        else:
            y = (x - np.array(self.centre, np.int64)).astype(np.float64)
        return (y - self.shift) @ self.axes

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sums of (n x - S)^2. The low 64 bits are exact; an estimate tells which fit a long."""
        centre = np.array(self.centre, np.int64)
        low = lambda v: np.array([k & (1 << 64) - 1 for k in v], np.uint64)
        y = (x.view(np.uint64) - centre.view(np.uint64)) * np.uint64(self.n & (1 << 64) - 1) - low(self.rest)
        total = (y * y).sum(axis=1, dtype=np.uint64)
        rough = self.n * (x.astype(np.float64) - centre) - np.array(self.rest, np.float64)
        size = (rough * rough).sum(axis=1)
        fits = size < 2.0**63
        for i in np.flatnonzero(np.abs(size / 2.0**63 - 1) < 1e-6):
            fits[i] = sum((self.n * (int(a) - c) - r) ** 2 for a, c, r in zip(x[i], self.centre, self.rest)) < 1 << 63
        return pa.array(total.view(np.int64), mask=~fits)

    def applied(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(self.values)
        for batch in batches:
            for begin, x in _vectors(batch, 1, self.dims, self.width):
                rows = np.repeat(np.arange(len(x)), k)
                ids = batch.column(0).slice(begin, len(x)).take(pa.array(rows))
                w = self.project(x).ravel()
                error = self.identity_error
                explained = [e / self.trace for e in self.values] if self.trace > 0 else [None] * k
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), longs(np.full(len(rows), self.n)),
                    self.deviations(x).take(pa.array(rows)), pa.array(w, mask=np.tile(~np.array(self.live, bool), len(x))),
                    pa.array(explained * len(x), pa.float64()), pa.array([error] * len(rows), pa.float64()),
                ], names=[f.split()[0] for f in _SCHEMA.split(", ")])


def _identity_error(fit: DataFrame, model: Model) -> float | None:
    """Largest entry of the covariance of the whitened fit list minus the identity, measured on its rows."""
    k, live = len(model.values), np.flatnonzero(model.live)
    if not len(live):
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            for _, x in _vectors(batch, 0, model.dims, model.width):
                w = model.project(x)
                total += np.concatenate([w.sum(axis=0), (w.T @ w).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), doubles(total)], names=["place", "value"])

    sums = fit.mapInArrow(add, "place int, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(k + k * k)
    for r in sums.collect():
        out[r["place"]] = r["value"]
    mean = out[:k] / model.n
    cov = out[k:].reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(cov - np.eye(k))[np.ix_(live, live)].max())


def count_above(a: np.ndarray, shift: float) -> int:
    """Eigenvalues above a shift: positive pivots of the LDL^T factors of the shifted matrix.

    Pivots are single entries or pairs, chosen so that no factor grows, as the matrix is indefinite.
    """
    m = a - shift * np.eye(len(a))
    positive = 0
    wide = (1 + math.sqrt(17)) / 8
    while len(m):
        below = np.abs(m[1:, 0])
        far = 0 if not len(below) else int(below.argmax()) + 1
        most = below[far - 1] if far else 0.0
        pair = False
        if abs(m[0, 0]) < wide * most:
            row = np.abs(m[far])
            row[far] = 0
            reach = row.max()
            if abs(m[0, 0]) * reach < wide * most * most:
                if abs(m[far, far]) >= wide * reach:
                    _swap(m, 0, far)
                else:
                    pair = True
                    _swap(m, 1, far)
        if pair:
            d, c = m[:2, :2], m[2:, :2]
            # a pair is chosen only if its determinant is negative: one eigenvalue on each side
            positive += 1
            m = m[2:, 2:] - c @ np.linalg.solve(d, c.T)
        else:
            p = m[0, 0]
            positive += p > 0
            m = m[1:, 1:] - np.outer(m[1:, 0], m[1:, 0]) / p if p != 0 else m[1:, 1:]
    return int(positive)


def _swap(m: np.ndarray, i: int, j: int) -> None:
    if i != j:
        m[[i, j]] = m[[j, i]]
        m[:, [i, j]] = m[:, [j, i]]


def leading(a: np.ndarray, k: int) -> list[tuple[float, np.ndarray]]:
    """The ``k`` largest eigenvalues of a symmetric matrix in falling order, with unit eigenvectors.

    Each is isolated by counts, refined by Rayleigh quotient iteration and certified by counts. Equal
    eigenvalues get orthogonal vectors.
    """
    scale = float(np.abs(a).max(initial=0))
    if scale == 0:
        return [(0.0, u) for u in np.eye(len(a))[:k]]
    m = a / scale
    radius = np.abs(m).sum(axis=1) - np.abs(np.diag(m))
    low, high = float((np.diag(m) - radius).min()) - 1e-3, float((np.diag(m) + radius).max()) + 1e-3
    tight = 8 * len(m) * _EPS * max(abs(low), abs(high))
    known = {low: len(m), high: 0}
    found: list[tuple[float, np.ndarray]] = []

    def above(x: float) -> int:
        if x not in known:
            known[x] = count_above(m, x)
        return known[x]

    for i in range(1, k + 1):
        begin = max(x for x, c in known.items() if c >= i)
        end = min(x for x, c in known.items() if c < i)
        spare = 3  # halvings after isolation, so that the iteration begins close
        while True:
            alone = above(begin) == i and above(end) == i - 1
            if end - begin <= tight or alone and spare == 0:
                pair = _refined(m, begin, end, alone, found, tight)
                if pair is not None:
                    break
            spare = max(0, spare - alone)
            middle = (begin + end) / 2
            begin, end = (middle, end) if above(middle) >= i else (begin, middle)
        found.append(pair)
    # values of one cluster may come in any order
    found.sort(key=lambda p: -p[0])
    return [(max(0.0, e) * scale, u) for e, u in found]


def _refined(
    m: np.ndarray, begin: float, end: float, alone: bool, found: list[tuple[float, np.ndarray]], tight: float
) -> tuple[float, np.ndarray] | None:
    """The eigenpair inside an interval, or None if the iteration leaves it or cannot be certified."""
    def outside(u: np.ndarray) -> np.ndarray:
        for _, v in [*found, *found]:
            u = u - (v @ u) * v
        return u / np.linalg.norm(u)

    def solved(shift: float, u: np.ndarray) -> np.ndarray:
        for nudge in (0.0, tight, -tight):
            try:
                y = np.linalg.solve(m - (shift + nudge) * np.eye(len(m)), u)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and np.abs(y).max() > 0:
                return y / np.linalg.norm(y)
        return u

    u = outside(np.random.default_rng(len(found)).standard_normal(len(m)))
    for _ in range(3 if alone else 8):
        u = outside(solved((begin + end) / 2, u))
    e = float(u @ m @ u)
    if not alone:
        return e, u
    for _ in range(12):
        if not begin <= e <= end:
            return None
        if np.linalg.norm(m @ u - e * u) <= tight / 4:
            break
        u = solved(e, u)
        e = float(u @ m @ u)
    u = outside(solved(e, u))
    e = float(u @ m @ u)
    error = 2 * float(np.linalg.norm(m @ u - e * u)) + tight
    i = len(found) + 1
    certified = count_above(m, e - error) >= i and count_above(m, e + error) <= i - 1
    return (e, u) if certified else None
