"""Word vectors of a vocabulary that stays on the executors."""

import heapq
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.feature import Word2VecModel
from pyspark.sql import functions as F

from lurescan.operators import tokens as H
from lurescan.operators import word_vectors as V


def texts(spark):
    rows = [(i, ["login", "verify", "a" if i % 2 else "b", "account", "secure"] if i % 4 < 2
             else ["blog", "post", "c" if i % 8 < 4 else "d", "news", "read"]) for i in range(600)]
    return spark.createDataFrame([*rows, (600, ["once"]), (601, []), (602, None)], "k int, tokens array<string>")


def near(found, x, y):
    return float(found[x] @ found[y] / math.sqrt((found[x] @ found[x]) * (found[y] @ found[y])))


def test_huffman_runs():
    """Shortest codes, no code twice, every inner node in use."""
    random.seed(5)
    for most in (1, 2, 6, 50):
        for size in (2, 3, 7, 64, 101):
            counts = sorted((random.randint(1, most) for _ in range(size)), reverse=True)
            nodes, bits = V.paths(np.arange(size), V.huffman_runs(Counter(counts).items()), size)
            heap, cost = sorted(counts), 0
            while len(heap) > 1:
                both = heapq.heappop(heap) + heapq.heappop(heap)
                cost += both
                heapq.heappush(heap, both)
            assert ((nodes >= 0).sum(axis=1) * counts).sum() == cost
            assert len({tuple(b[n >= 0][::-1]) for n, b in zip(nodes, bits)}) == size
            assert set(nodes[nodes >= 0].tolist()) == set(range(size, 2 * size - 1))


def test_large_vocabulary_stays_off_the_driver(spark):
    """The same vectors in kind as Spark's operator gives, which collects them in each round."""
    df = texts(spark)
    small, large = H.word2vec_fit(df.filter("tokens IS NOT NULL")), H.word2vec_fit(df, driver_vocabulary=12)
    assert isinstance(small, Word2VecModel) and isinstance(large, V.WordVectors)
    was, found = ({r["token"]: np.array(r["vector"]) for r in H.vectors_of(m).collect()} for m in (small, large))
    assert set(found) == set(was) and all(v.shape == (50,) for v in found.values())
    assert near(found, "a", "b") > near(found, "a", "c") and near(found, "c", "d") > near(found, "b", "d")
    for token in ("login", "a", "news", "d"):
        assert np.linalg.norm(found[token]) == pytest.approx(np.linalg.norm(was[token]), rel=0.25)
    assert large.getVectors().columns == small.getVectors().columns


def test_averaged_parts(spark):
    """Several parts are averaged after each round; rare tokens are left out, others keep what they learnt."""
    model = V.fit(texts(spark), "tokens", 8, 5, 3, tokens_per_part=1000, min_count=100)
    found = {r["token"]: np.array(r["vector"]) for r in H.vectors_of(model).collect()}
    assert set(found) == {"login", "verify", "a", "b", "account", "secure", "blog", "post", "c", "d", "news", "read"}
    assert near(found, "a", "b") > near(found, "a", "c")


def test_one_token(spark):
    df = spark.createDataFrame([(["x", "x"],), (["x"],)], "tokens array<string>")
    (row,) = H.vectors_of(V.fit(df, "tokens", 4, 5, 2, tokens_per_part=100)).collect()
    assert row["token"] == "x" and len(row["vector"]) == 4 and all(abs(v) <= 0.125 for v in row["vector"])


def test_vocabulary_of_a_large_table(spark):
    """Spark's operator trains a vocabulary of the size that a table of 1 GB has."""
    df = spark.range(70_000).select(F.array(F.concat(F.lit("t"), F.col("id").cast("string"))).alias("tokens"))
    model = H.word2vec_fit(df, epochs=1)
    assert isinstance(model, Word2VecModel) and model.getVectors().count() == 70_000


def test_train_learns_pair_by_pair():
    """The same vectors as the plain rule gives, with tokens that come twice in a text and settled pairs."""
    rng = np.random.default_rng(3)
    counts = sorted((int(n) for n in rng.integers(1, 40, 30)), reverse=True)
    up, bits = V.paths(np.arange(30), V.huffman_runs(Counter(counts).items()), 30)
    words, ends = rng.integers(0, 30, 200), np.array([1, 8, 8, 60, 200])
    first = rng.normal(0, 0.6, (59, 50)).astype(np.float32)
    found, plain = first.copy(), first.astype(float)
    V.train(words, ends, found, up, bits, 5, 0, 1, np.random.default_rng(9))
    rng, begin, settled = np.random.default_rng(9), 0, 0
    for end in ends:
        for at, reach in zip(range(begin, end), rng.integers(1, 6, end - begin)):
            path = up[words[at]][up[words[at]] >= 0]
            label = 1 - bits[words[at], :len(path)]
            for near in range(max(begin, at - reach), min(end, at + reach + 1)):
                if near != at:
                    f = plain[path] @ plain[words[near]]
                    g = V.LEARNING_RATE * (label - 1 / (1 + np.exp(-f))) * (np.abs(f) < V.SETTLED)
                    settled += (np.abs(f) >= V.SETTLED).sum()
                    step = g @ plain[path]
                    plain[path] += g[:, None] * plain[words[near]]
                    plain[words[near]] += step
        begin = end
    assert settled and np.abs(found - first).max() > 0.1 and np.allclose(found, plain, atol=1e-3)
