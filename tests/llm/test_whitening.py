"""Whitened embeddings against exact arithmetic and a full eigendecomposition."""

import math
from collections import Counter

import numpy as np
import pytest

from lurescan.llm import queries, whitening
from llm_helpers import FOLDER, read


def spectrum(kind, n=24):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.standard_normal((n, n)))
    values = {
        "spread": np.geomspace(1, 1e-6, n), "close": np.r_[1, 1 - 1e-9, 1 - 2e-9, 0.5, np.full(n - 4, 0.1)],
        "equal": np.r_[np.full(6, 2.0), np.full(n - 6, 1.0)], "rank two": np.r_[3.0, 1.0, np.zeros(n - 2)],
        "negative": np.linspace(5, -5, n),
    }[kind]
    a = (q * values) @ q.T
    return (a + a.T) / 2, values


@pytest.mark.parametrize("kind", ["spread", "close", "equal", "rank two", "negative"])
def test_leading_pairs(kind):
    a, values = spectrum(kind)
    pairs = whitening.leading(a, 4)
    want = np.sort(np.linalg.eigvalsh(a))[::-1][:4]
    assert np.allclose([e for e, _ in pairs], want, atol=1e-12)
    u = np.array([v for _, v in pairs])
    assert np.allclose(u @ u.T, np.eye(4), atol=1e-9)
    for e, v in pairs:
        assert np.linalg.norm(a @ v - e * v) < 1e-12


@pytest.mark.parametrize("kind", ["spread", "close", "equal", "rank two", "negative"])
def test_inertia_counts(kind):
    a, _ = spectrum(kind)
    values = np.linalg.eigvalsh(a)
    for shift in (-6, -1.3, 0.0501, 0.7, 0.99, 1.5, 2.5, 4.1, 9):
        assert whitening.count_above(a, shift) == (values > shift).sum()


def test_multiples_of_the_identity():
    for n in (1, 2, 5):
        pairs = whitening.leading(3.0 * np.eye(n), min(4, n))
        u = np.array([v for _, v in pairs])
        assert np.allclose([e for e, _ in pairs], 3) and np.allclose(u @ u.T, np.eye(len(u)), atol=1e-12)


def test_inertia_of_matrices_with_a_zero_diagonal():
    rng = np.random.default_rng(4)
    for n in range(1, 14):
        a = rng.integers(-2, 3, (n, n)).astype(float)
        a = a + a.T
        np.fill_diagonal(a, 0)
        assert whitening.count_above(a, 0.123) == (np.linalg.eigvalsh(a) > 0.123).sum()


def expected(rows, dims):
    """Rows of exact n and deviation, and the covariance, from whole numbers."""
    kept = [(i, [math.floor(256 * float(c)) for c in v] + [0] * (dims - len(v))) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n = len(fit)
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    return kept, n, sums, centred.T @ centred / n


def check(got, rows, dims):
    kept, n, sums, v = expected(rows, dims)
    k = min(4, dims)
    want = Counter()
    for i, x in kept:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
        want[(i, n, deviation)] += 1
    seen = Counter((r.vec_id, r.n, r.deviation) for r in got if r.component == 1)
    assert seen == want and len(got) == k * len(kept)
    values, vectors = np.linalg.eigh(v)
    top, axes = values[::-1][:k], vectors[:, ::-1][:, :k]
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        w = np.array([by[(i, c + 1)].whitened for i, _ in kept])
        p = np.array([(np.array(x) - np.array(sums) / n) @ axes[:, c] for _, x in kept]) / math.sqrt(top[c])
        assert min(np.abs(w - p).max(), np.abs(w + p).max()) < 1e-6 * max(1, np.abs(p).max())
        assert all(abs(by[(i, c + 1)].explained - top[c] / np.trace(v)) < 1e-9 for i, _ in kept)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_the_table(spark):
    rows = [(r.vec_id, r.embedding) for r in read(spark, "embeddings").collect()]
    check(queries.QUERIES["op12_whitening"](spark, FOLDER).collect(), rows, 64)


SCHEMA = "vec_id bigint, embedding array<float>, x string, component int, n int, whitened double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 9, 9, 0.5) for i, v in rows], SCHEMA)


def test_edge_rows(spark):
    rng = np.random.default_rng(8)
    good = [(i, [float(np.float32(c)) for c in rng.standard_normal(5) * [3, 2, 1, 0.5, 40]]) for i in range(40)]
    rows = good + [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [math.nan] * 5), (103, [1.0, math.inf, 0.0, 0.0, 0.0])]
    rows += [(200 + i, good[0][1]) for i in range(30)] + [(300, [-0.0, 0.5]), (301, [])]
    check(whitening.whitened(frame(spark, rows)).collect(), rows, 5)


def test_repeated_and_missing_ids(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [3.0, 1.0]), (None, [0.0, 5.0]), (2, [3.0, 1.0])]
    got = whitening.whitened(frame(spark, rows)).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 4, 2: 2} and {r.n for r in got} == {3}


def test_nothing_one_vector_and_one_dimension(spark):
    assert whitening.whitened(frame(spark, [])).count() == 0
    assert whitening.whitened(frame(spark, [(1, None)])).count() == 0
    got = whitening.whitened(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got] == [(1, 0, None, None, None)] * 4
    got = whitening.whitened(frame(spark, [(i, [float(i)]) for i in range(4)])).collect()
    assert [r.component for r in got] == [1] * 4 and abs(got[0].identity_error) < 1e-12 and got[0].explained == 1.0
    got = whitening.whitened(frame(spark, [(i, [float(i), 1.0]) for i in range(4)])).collect()
    assert [r.whitened is None for r in got] == [False, True] * 4


@pytest.mark.parametrize("size", [1e5, 1e12, 3e38])
def test_large_entries(spark, size):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(size * c)) for c in rng.uniform(-1, 1, 3)]) for i in range(20)]
    got = whitening.whitened(frame(spark, rows)).collect()
    kept, n, sums, v = expected([(i, [min(max(c, -(2.0**55)), 2.0**55) for c in x]) for i, x in rows], 3)
    assert len(got) == 60 and got[0].identity_error < 1e-6
    if size < 1e38:
        for r in got:
            want = sum((n * a - s) ** 2 for a, s in zip(dict(kept)[r.vec_id], sums))
            assert r.deviation == (want if want < 2**63 else None)


def test_a_common_offset_costs_no_digits(spark):
    rng = np.random.default_rng(10)
    rows = [(i, [float(np.float32(30000 + c)) for c in rng.standard_normal(6)]) for i in range(60)]
    check(whitening.whitened(frame(spark, rows)).collect(), rows, 6)
