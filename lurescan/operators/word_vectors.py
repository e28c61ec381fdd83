"""Skip-gram vectors of a vocabulary that stays on the executors.

The method is that of Spark's Word2Vec: hierarchical softmax over a Huffman tree of the token counts, a falling
learning rate, partitions trained on their own and averaged after each round. Tokens and inner nodes of the tree
are numbered alike, and the table of their vectors is joined with the partitions that need them.
"""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.operators.tables import cut_lineage, join_split_hot, with_row_number

# executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEARNING_RATE = 0.025
#: The learning rate is set anew after so many words.
WORDS_PER_RATE = 10_000
#: Beyond this the sigmoid counts as settled and nothing is learnt, as in Spark's Word2Vec.
SETTLED = 6.0
#: Vectors in a batch that a task returns.
ROWS_PER_BATCH = 10_000


@dataclass
class WordVectors:
    """Trained vectors with the reading side of Spark's ``Word2VecModel``."""

    vectors: DataFrame

    def getVectors(self) -> DataFrame:  # noqa: N802
        return self.vectors.select(F.col("token").alias("word"), array_to_vector("vector").alias("vector"))


def token_counts(df: DataFrame, tokens: str, min_count: int) -> DataFrame:
    """token, n: the vocabulary."""
    words = df.select(F.explode(tokens).alias("token")).filter("token IS NOT NULL")
    return words.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= min_count)


def huffman_runs(histogram: Iterable[tuple[int, int]]) -> np.ndarray:
    """The Huffman tree of ``(count, number of tokens)`` pairs in runs of nodes that have equal counts.

    Tokens are 0 to V-1 by falling count, inner nodes V to 2V-2, the last is the root. A row ``first, offset,
    parent``: node ``first + i`` has place ``j = offset + i`` in its run, the parent ``parent + j // 2`` and the
    bit ``j % 2``. Nodes of one count are merged at once, so the work follows the number of different counts.
    """
    # count, tokens after inner nodes, first node, nodes
    heap, first = [], 0
    for n, tokens in sorted(histogram, reverse=True):
        heap.append((n, 1, first, tokens))
        first += tokens
    heapq.heapify(heap)
    new, rows, odd = first, [], None
    while heap:
        n = heap[0][0]
        group = []
        while heap and heap[0][0] == n:
            group.append(list(heapq.heappop(heap)[2:]))
        if odd is not None:
            # the odd node of the run before goes with the first one of this
            rows += [(odd[1], 0, new), (group[0][0], 1, new)]
            heapq.heappush(heap, (odd[0] + n, 0, new, 1))
            new, odd = new + 1, None
            group[0] = [group[0][0] + 1, group[0][1] - 1]
        group = [g for g in group if g[1]]
        total = sum(k for _, k in group)
        if total % 2:
            odd = (n, sum(group[-1]) - 1)
            group[-1][1] -= 1
        place = 0
        for start, k in group:
            if k:
                rows.append((start, place, new))
            place += k
        if total > 1:
            heapq.heappush(heap, (2 * n, 0, new, total // 2))
            new += total // 2
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 3)


def paths(tokens: np.ndarray, runs: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Inner nodes from each token up to the root (-1: beyond it), and the bits below them."""
    nodes, bits, at = [], [], tokens
    while (inside := (at >= 0) & (at < 2 * vocabulary - 2)).any():
        first, offset, parent = runs[np.searchsorted(runs[:, 0], at, "right") - 1].T
        place = offset + at - first
        at = np.where(inside, parent + place // 2, -1)
        nodes.append(at)
        bits.append((place % 2).astype(np.float32))
    shape = (len(nodes), len(tokens))
    return np.reshape(nodes, shape).astype(np.int64).T, np.reshape(bits, shape).astype(np.float32).T


def train(
    words: np.ndarray, ends: np.ndarray, vectors: np.ndarray, up: np.ndarray, bits: np.ndarray,
    window: int, done: float, share: float, rng: np.random.Generator,
) -> None:
    """One round over texts, whose words are places in ``vectors``; it changes the vectors.

    ``up`` and ``bits`` hold the tree path of each word, -1 beyond its root. The learning rate follows Spark's
    Word2Vec: a round begins with the full rate, then it falls with ``done``, the part of all rounds before this
    one, and with the words so far; ``share`` is what this round adds.
    """
    up, halves, depth = np.ascontiguousarray(up), np.ascontiguousarray(0.5 - bits), (up >= 0).sum(axis=1).tolist()
    kind, size = vectors.dtype, vectors.shape[1]
    # the arrays of a pair by the length of its path: in short arrays making a new one costs as much as the sums
    rooms = [
        (np.empty((n, size), kind), np.empty((n, size), kind), np.empty(n, kind), np.empty(n, kind), np.empty(n, bool))
        for n in range(up.shape[1] + 1)
    ]
    step, middle = np.empty(size, kind), kind.type(0.5)
    dot, multiply, add = np.dot, np.multiply, np.add
    rate, begin, rated = LEARNING_RATE, 0, 0
    for end in ends.tolist():
        text = words[begin:end].tolist()
        if begin - rated > WORDS_PER_RATE:
            rate, rated = LEARNING_RATE * max(1e-4, 1 - done - share * begin / len(words)), begin
        for at, reach in enumerate(rng.integers(1, window + 1, len(text)).tolist()):
            word, levels = text[at], depth[text[at]]
            path = up[word, :levels]
            target, half = halves[word, :levels] * kind.type(rate), kind.type(rate / 2)
            y, product, f, g, open_ = rooms[levels]
            vectors.take(path, 0, y, "clip")
            column = g[:, None]
            # one pair at a time: what a pair learns counts for the next
            for other in text[max(0, at - reach):at] + text[at + 1:at + 1 + reach]:
                x = vectors[other]
                dot(y, x, f)
                np.abs(f, g)
                np.less(g, SETTLED, open_)
                # the label less the sigmoid, by its tanh form
                multiply(f, middle, g)
                np.tanh(g, g)
                multiply(g, half, g)
                np.subtract(target, g, g)
                multiply(g, open_, g)
                dot(g, y, step)
                multiply(column, x, product)
                add(y, product, y)
                add(x, step, x)
            vectors[path] = y
        begin = end


def fit(
    df: DataFrame, tokens: str, size: int, window: int, epochs: int, tokens_per_part: int, min_count: int = 1,
    seed: int = 42,
) -> WordVectors:
    """Vectors of all tokens that occur ``min_count`` times; the driver sees the counts' histogram only.

    The histogram has fewer rows than the square root of twice the number of tokens. Tokens of one count come by
    a hash, so that neighbours in the tree have nothing else in common.
    """
    order = F.struct((-F.col("n")).alias("n"), F.xxhash64("token").alias("hash"), "token")
    ranked = token_counts(df, tokens, min_count).withColumn("_order", order)
    numbered = cut_lineage(with_row_number(ranked, "_order", "id").select("token", "id", "n"))
    histogram = [(r["n"], r["count"]) for r in numbered.groupBy("n").count().collect()]
    vocabulary = sum(k for _, k in histogram)
    runs = huffman_runs(histogram)
    parts = max(1, -(-sum(n * k for n, k in histogram) // tokens_per_part))

    row = F.monotonically_increasing_id()
    texts = cut_lineage(df.select(row.alias("row"), F.col(tokens).alias("tokens")).filter(F.size("tokens") > 0))
    words = texts.select(
        (F.col("row") % parts).cast("int").alias("part"), "row", F.posexplode("tokens").alias("pos", "token"))
    known = join_split_hot(words, numbered.select("token", "id"), "token", "inner")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "id")))
    sentences = cut_lineage(known.groupBy("part", "row").agg(F.transform(ordered, lambda x: x["id"]).alias("ids")))

    def nodes_of(key, rows):
        own = np.unique(rows["ids"].combine_chunks().flatten().to_numpy())
        found = np.union1d(own, paths(own, runs, vocabulary)[0])
        found = found[found >= 0]
        return pa.table({"part": np.full(len(found), key[0].as_py(), dtype=np.int32), "node": found})

    def trained_for(rounds: list[int]):
        def run(key, rows, given):
            order = np.argsort(given["node"].to_numpy())
            nodes = given["node"].to_numpy()[order]
            before = given["vector"].combine_chunks().flatten().to_numpy().reshape(-1, size)[order]
            up, bits = paths(nodes[nodes < vocabulary], runs, vocabulary)
            up = np.where(up < 0, -1, np.searchsorted(nodes, up))
            texts = rows.sort_by("row")["ids"].combine_chunks()
            words, ends = np.searchsorted(nodes, texts.flatten().to_numpy()), np.cumsum(texts.value_lengths().to_numpy())
            vectors = before.copy()
            for k in rounds:
                rng = np.random.default_rng([seed, key[0].as_py(), k])
                train(words, ends, vectors, up, bits, window, k / epochs, 1 / epochs, rng)
            changed = (vectors != before).any(axis=1)
            lists = pa.ListArray.from_arrays(
                np.arange(changed.sum() + 1, dtype=np.int32) * size, pa.array(vectors[changed].ravel()))
            found = pa.table({"node": nodes[changed], "vector": lists})
            return pa.Table.from_batches(found.to_batches(max_chunksize=ROWS_PER_BATCH), found.schema)
        return run

    needed = cut_lineage(sentences.groupBy("part").applyInArrow(nodes_of, "part int, node long"))
    numbers = F.transform(
        F.sequence(F.lit(1), F.lit(size)),
        lambda i: ((F.pmod(F.xxhash64(F.col("node"), i, F.lit(seed)), F.lit(1 << 24)) / (1 << 24) - 0.5) / size).cast("float"),
    )
    zeros = F.array_repeat(F.lit(0.0).cast("float"), size)
    state = df.sparkSession.range(max(1, 2 * vocabulary - 1)).withColumnRenamed("id", "node").withColumn(
        "vector", F.when(F.col("node") < vocabulary, numbers).otherwise(zeros))
    # partitions are averaged after each round; a single one needs no exchange between them
    stretches = [[k] for k in range(epochs)] if parts > 1 else [list(range(epochs))]
    # merge joins: a broadcast would bring the vectors to the driver
    for rounds in stretches:
        given = needed.join(state.hint("merge"), "node")
        trained = sentences.groupBy("part").cogroup(given.groupBy("part")).applyInArrow(
            trained_for(rounds), "node long, vector array<float>")
        mean = trained.groupBy("node").agg(*[F.avg(F.get("vector", F.lit(i))).alias(f"v{i}") for i in range(size)])
        mean = mean.select("node", F.array(*[F.col(f"v{i}").cast("float") for i in range(size)]).alias("mean"))
        state = cut_lineage(state.join(mean.hint("merge"), "node", "left").select(
            "node", F.coalesce("mean", "vector").alias("vector")))
    vectors = state.withColumnRenamed("node", "id").join(numbered.hint("merge"), "id")
    return WordVectors(vectors.select("token", "vector"))
