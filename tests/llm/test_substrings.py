"""Removal of repeated passages against brute force."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescan.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(rows, window):
    first = {}
    words = [(d, WORD.findall(t or "")) for d, t in rows]
    key = lambda d: substrings.NO_ID if d is None else d
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key(d):
                gone |= set(range(i, i + window))
        spans = []
        for i in sorted(gone):
            if spans and spans[-1][1] == i:
                spans[-1][1] = i + 1
            else:
                spans.append([i, i + 1])
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), kept, tuple(a for a, _ in spans), tuple(b for _, b in spans)))
    return Counter(out)


def got(df):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept, tuple(r.begins), tuple(r.ends)) for r in df.collect())


@pytest.mark.parametrize("window", [13, 3, 1])
def test_edge_rows(spark, edge, none, window):
    rows = [(r.doc_id, r.text) for r in edge.collect()]
    assert got(substrings.deduplicated(edge, window)) == expected(rows, window)
    assert substrings.deduplicated(none, window).count() == 0


@pytest.fixture
def passages(spark):
    """Passages that overlap, repeat inside a text, meet at their ends and lie at both ends of texts."""
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(40)] + ["é", "\U0001f600", "a,b", "THE", "the"]
    bank = [" ".join(rng.choice(words, n)) for n in (3, 5, 8, 13, 21, 40)]
    rows = []
    for i in range(300):
        parts = [str(rng.choice(bank)) if rng.random() < 0.6 else " ".join(rng.choice(words, 6)) for _ in range(rng.integers(0, 7))]
        rows.append((int(rng.integers(0, 250)), ("\n" if i % 3 else " \t ").join(parts)))
    rows += [(1000 + i, "same " * 70 + str(i)) for i in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)


@pytest.mark.parametrize("window", [13, 4])
def test_passages(passages, window):
    rows, df = passages
    assert got(substrings.deduplicated(df, window)) == expected(rows, window)


def test_many_blocks_small_slices_and_hot_minimizers(passages, monkeypatch):
    rows, df = passages
    monkeypatch.setattr(substrings, "SLICE", 300)
    monkeypatch.setattr(substrings, "BLOCK", 40)
    monkeypatch.setattr(substrings, "STRETCH", 4)
    sliced = df.mapInArrow(substrings._pack, "slice_id bigint, body binary")
    assert len(substrings._hot_minimizers(sliced, 5)) > 0
    assert got(substrings.deduplicated(df, 5)) == expected(rows, 5)


def test_factors_follow_their_source():
    symbols = np.array([5, 6, 7, 8, 1, 5, 6, 7, 9, 7, 8], np.uint64)
    flags, factors = substrings.parse(symbols, np.array([4, 7]), np.array([1, 2]))
    assert flags.tolist() == [False] * 5 + [True] * 3 + [False] + [True] * 2
    assert sorted(map(tuple, factors.tolist())) == [(5, 0, 3), (9, 2, 2)]
    flags, factors = substrings.parse(symbols, np.array([4, 7]), np.array([1, 1]))
    assert not flags.any() and len(factors) == 0


def test_a_passage_in_every_row_costs_a_block_one_entry_a_slice(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + f" tail {i}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2)
    out = substrings.deduplicated(df).groupBy("n_removed").count().collect()
    assert {r[0]: r[1] for r in out} == {0: 1, 61: 1999}
    sliced = df.mapInArrow(substrings._pack, "slice_id bigint, body binary").collect()
    for slice_id, body in sliced:
        s = substrings._Slice(bytes(body), 13, np.zeros(0, np.uint64), 3)
        sent = sum(len(b.as_py()) // 8 for batch in substrings._stretches(slice_id, s) for b in batch.column(4))
        assert sent < 60 + 3 * len(s.ids)


def test_a_long_text(spark):
    long = " ".join(f"x{i % 5000}" for i in range(400_000))
    df = spark.createDataFrame([(1, " ".join(f"x{i}" for i in range(100, 200))), (2, long), (3, "z" * 3_000_000)], "doc_id bigint, text string")
    out = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.deduplicated(df).select("doc_id", "n_words", "n_removed").collect()}
    assert out == {1: (100, 0), 2: (400_000, 80 * 100), 3: (1, 0)}


def test_other_columns_are_not_read(spark):
    df = spark.range(3).withColumn("doc_id", F.col("id")).withColumn("text", F.lit("a b")).withColumn("slice_id", F.lit("x"))
    assert substrings.deduplicated(df).count() == 3
