"""Repeated passages: relative Lempel-Ziv parsing of every document against indexed reference blocks.

The symbols of the parse are windows of consecutive words, one per word position. The corpus itself is
the reference, cut into blocks by content: a window goes to the block of its minimizer, the least hash
of the five-word runs inside it. Equal windows share their minimizer, so each window has to be looked
for in one block only, and neighbouring windows mostly go to the same block as one stretch.

A block indexes the stretches of all documents and factors each stretch greedily: a factor begins at a
window that an earlier document has, and goes on as long as the source goes on with the same words. A
factor of one window is a whole passage of ``window`` words already. Where a factor ends, the next
symbol is the window across that boundary, which is looked up again. The words of all factors together
are the duplicate spans of a document.

Documents travel as compressed slices of some megabytes, and a slice names each distinct stretch once,
so a passage that a third of all rows share costs a block one entry per slice. Minimizers that would
fill more than a block send their windows one by one, spread by the hash of the whole window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescan.llm.text import as_bytes, mixed, repeated_ranges, slices, word_bounds, word_hashes

WINDOW = 13

#: Words of the runs whose least hash chooses the block of a window.
ANCHOR = 5

#: Text bytes of a slice (a longer text is a slice of its own), and windows that a block should have.
SLICE, BLOCK = 1 << 21, 1 << 19

#: A stretch has at most so many windows.
STRETCH = 32

#: Minimizers with this share of the windows of a slice are counted over the corpus.
COUNTED = 1 << 14

#: Text bytes that go to one partition of slices.
PART = 1 << 26

NO_ID = np.iinfo(np.int64).max

_ROLL = np.uint64(0x9E3779B97F4A7C15)


def deduplicated(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept, begins, ends``: each text without passages of earlier documents.

    A word goes if a window of ``window`` words around it also starts in a document with a smaller
    doc_id. ``kept`` is what is left, joined by one space; ``begins, ends`` are the removed spans in words
    (end exclusive). One row per input row. NULL and empty texts, and texts without a word, keep an
    empty string; a text of fewer words than a window keeps all. Rows with the same doc_id never remove
    from each other. Rows without doc_id count as one document after all others: they lose what others
    have, and nothing is lost to them. Other columns are not read. Windows are equal if 64-bit hashes
    of theirs are and they meet in a block; words are compared as bytes.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // (6 * BLOCK)))
    sliced = docs.mapInArrow(_pack, "slice_id bigint, body binary")
    hot = _hot_minimizers(sliced, window)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART))
    # both readers below use this one shuffle of the texts
    dealt = sliced.repartition(parts, "slice_id")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slice_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield from _stretches(slice_id, _Slice(body, window, hot, blocks))

    sent = dealt.mapInArrow(send, "slice_id bigint, block bigint, docs binary, lengths binary, symbols binary")
    found = sent.groupBy("block").applyInArrow(_factored, "slice_id bigint, block bigint, bits binary")

    def cut(bodies: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("block")
        bits = answers.column("bits").to_pylist()
        return pa.concat_tables(
            _Slice(body, window, hot, blocks).without(bits) for body in bodies.column("body").to_pylist()
        ) if bodies.num_rows else _nothing()

    kept = "doc_id bigint, n_words bigint, n_removed bigint, kept string, begins array<bigint>, ends array<bigint>"
    return dealt.groupBy("slice_id").cogroup(found.groupBy("slice_id")).applyInArrow(cut, kept)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of rows as compressed Arrow messages, numbered by task and place."""
    number = TaskContext.get().partitionId() << 33
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    for batch in batches:
        for part in slices(batch, SLICE):
            part = pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(part.column(1).to_pylist(), pa.string())], names=["doc_id", "text"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=options) as out:
                out.write_batch(part)
            body = pa.array([sink.getvalue().to_pybytes()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), body], names=["slice_id", "body"])
            number += 1


def _hot_minimizers(sliced: DataFrame, window: int) -> np.ndarray:
    """Minimizers of more windows than a block holds; there are at most as many as blocks."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column(1).to_pylist():
                s = _Slice(body, window, None, 1)
                keys, counts = np.unique(s.keys[s.valid], return_counts=True)
                often = counts >= max(2, len(s.keys) // COUNTED)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[often].view(np.int64)), pa.array(counts[often])], names=["minimizer", "n"])

    counts = sliced.mapInArrow(count, "minimizer bigint, n bigint")
    totals = counts.groupBy("minimizer").agg(F.sum("n").alias("n")).filter(F.col("n") > BLOCK)
    return np.sort(np.array([r[0] for r in totals.select("minimizer").collect()], np.int64).view(np.uint64))


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive word hashes; fewer words have none."""
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out = out * _ROLL + h[j : j + n]
    return mixed(out)


class _Slice:
    """The words of a slice's texts, their windows, and the distinct stretches of windows.

    The same body gives the same stretches in the same order wherever it is computed.
    """

    def __init__(self, body: bytes, window: int, hot: np.ndarray | None, blocks: int):
        rows = pa.ipc.open_stream(body).read_all().combine_chunks()
        ids, texts = rows.column(0).combine_chunks(), rows.column(1).combine_chunks()
        self.ids, self.window = ids, window
        self.doc_keys = ids.fill_null(NO_ID).to_numpy(zero_copy_only=False)
        self.buf, offsets = as_bytes(texts)
        blank = (self.buf == 32) | ((self.buf >= 9) & (self.buf <= 13))
        self.word_begins, self.word_ends, self.first = word_bounds(~blank, offsets)
        h = word_hashes(self.buf, self.word_begins, self.word_ends)
        owner = np.repeat(np.arange(len(ids)), np.diff(self.first))
        self.symbols = _rolled(h, window)
        n = len(self.symbols)
        self.valid = owner[:n] == owner[window - 1 :] if n else np.zeros(0, bool)
        anchor = min(ANCHOR, window)
        grams = _rolled(h, anchor)
        self.keys = grams[:n].copy()
        for j in range(1, window - anchor + 1):
            np.minimum(self.keys, grams[j : j + n], out=self.keys)
        if hot is not None:
            self._cut(owner, hot, blocks)

    def _cut(self, owner: np.ndarray, hot: np.ndarray, blocks: int) -> None:
        at = np.flatnonzero(self.valid)
        keys, symbols = self.keys[at], self.symbols[at]
        alone = np.zeros(len(at), bool)
        if len(hot):
            place = np.minimum(np.searchsorted(hot, keys), len(hot) - 1)
            alone = hot[place] == keys
        head = np.ones(len(at), bool)
        head[1:] = (np.diff(at) > 1) | (keys[1:] != keys[:-1]) | (owner[at[1:]] != owner[at[:-1]]) | alone[1:]
        run = np.cumsum(head) - 1
        inside = np.arange(len(at)) - np.flatnonzero(head)[run]
        heads = np.flatnonzero(head | (inside % STRETCH == 0))
        lengths = np.diff(np.append(heads, len(at)))
        inside = np.arange(len(at)) - np.repeat(heads, lengths)
        named = mixed(symbols + inside.astype(np.uint64) * _ROLL)
        names = np.add.reduceat(named, heads) if len(heads) else named
        docs = self.doc_keys[owner[at[heads]]]
        route = np.where(alone[heads], symbols[heads], keys[heads])
        block = (mixed(route ^ _ROLL) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((docs, names))
        new = np.ones(len(order), bool)
        new[1:] = names[order[1:]] != names[order[:-1]]
        same = np.empty(len(order), np.int64)
        same[order] = np.cumsum(new) - 1
        distinct = order[new]
        sort = np.lexsort((docs[distinct], block[distinct]))
        rank = np.empty(len(sort), np.int64)
        rank[sort] = np.arange(len(sort))
        chosen = distinct[sort]
        # of each stretch: the distinct one, its document, where its windows begin
        self.same, self.docs, self.begins, self.lengths = rank[same], docs, at[heads], lengths
        self.chosen, self.block = chosen, block[chosen]

    def without(self, bits: list[bytes]) -> pa.Table:
        """The rows without the words of windows that a document with a smaller id has.

        ``bits`` has one flag per window of the distinct stretches of each block, in the order of blocks.
        """
        sizes = self.lengths[self.chosen]
        per_block = np.add.reduceat(sizes, np.flatnonzero(np.diff(self.block, prepend=-1))) if len(sizes) else []
        if len(bits) != len(per_block):
            raise RuntimeError("blocks and slices do not belong together")
        flags = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(bits, per_block)]
        flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        starts = np.cumsum(sizes) - sizes
        owners, places = repeated_ranges(self.lengths)
        earlier = flags[starts[self.same[owners]] + places]
        earlier |= (self.docs > self.docs[self.chosen][self.same])[owners]
        hits = (self.begins[owners] + places)[earlier]
        n = len(self.word_begins)
        change = np.zeros(n + 1, np.int64)
        np.add.at(change, hits, 1)
        np.add.at(change, np.minimum(hits + self.window, n), -1)
        return self._table(np.cumsum(change[:n]) > 0)

    def _table(self, gone: np.ndarray) -> pa.Table:
        counts = np.diff(self.first)
        owner = np.repeat(np.arange(len(counts)), counts)
        removed = np.bincount(owner[gone], minlength=len(counts))
        begins, ends = self.word_begins[~gone], self.word_ends[~gone]
        mine = owner[~gone]
        blank = np.ones(len(mine), np.int64)
        blank[:-1] = mine[1:] == mine[:-1]
        blank[-1:] = 0
        sizes = ends - begins + blank
        words, places = repeated_ranges(sizes)
        data = self.buf[np.minimum(begins[words] + places, max(0, len(self.buf) - 1))]
        data[(np.cumsum(sizes) - 1)[blank > 0]] = 32
        lengths = np.bincount(mine, weights=sizes, minlength=len(counts)).astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        kept = pa.LargeStringArray.from_buffers(len(counts), pa.py_buffer(offsets), pa.py_buffer(data.tobytes()))
        edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
        new = np.ones(len(gone) + 1, bool)
        new[1:-1] = owner[1:] != owner[:-1]
        inner = np.flatnonzero(new[1:-1] & gone[1:] & gone[:-1]) + 1 if len(gone) > 1 else np.zeros(0, np.int64)
        opens = np.sort(np.concatenate([np.flatnonzero(edge == 1), inner]))
        closes = np.sort(np.concatenate([np.flatnonzero(edge == -1), inner]))
        spans = np.concatenate([[0], np.cumsum(np.bincount(owner[opens], minlength=len(counts)))]).astype(np.int32)
        base = self.first[owner[opens]]
        lists = [pa.ListArray.from_arrays(pa.array(spans), pa.array(x - base)) for x in (opens, closes)]
        return pa.Table.from_arrays(
            [self.ids, pa.array(counts), pa.array(removed.astype(np.int64)), kept.cast(pa.string()), *lists], names=_NAMES)


_NAMES = ["doc_id", "n_words", "n_removed", "kept", "begins", "ends"]


def _nothing() -> pa.Table:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return pa.Table.from_arrays([pa.array([], t) for t in types], names=_NAMES)


def _stretches(slice_id: int, s: _Slice) -> Iterator[pa.RecordBatch]:
    """The distinct stretches of a slice, one row for each block that gets any."""
    owners, places = repeated_ranges(s.lengths[s.chosen])
    symbols = s.symbols[s.begins[s.chosen][owners] + places]
    heads = np.flatnonzero(np.diff(s.block, prepend=-1))
    ends = np.append(heads[1:], len(s.block))
    till = np.concatenate([[0], np.cumsum(s.lengths[s.chosen])])
    docs, lengths = s.docs[s.chosen], s.lengths[s.chosen].astype(np.uint8)
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(len(heads), slice_id, np.int64)),
        pa.array(s.block[heads]),
        pa.array([docs[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()),
        pa.array([lengths[a:b].tobytes() for a, b in zip(heads, ends)], pa.binary()),
        pa.array([symbols[till[a] : till[b]].tobytes() for a, b in zip(heads, ends)], pa.binary()),
    ], names=["slice_id", "block", "docs", "lengths", "symbols"])


def _factored(rows: pa.Table) -> pa.Table:
    """Factor the stretches of a block; one flag per window that an earlier document has."""
    read = lambda name, kind: [np.frombuffer(b, kind) for b in rows.column(name).to_pylist()]
    lengths = read("lengths", np.uint8)
    docs = np.concatenate(read("docs", np.int64))
    symbols = np.concatenate(read("symbols", np.uint64))
    sizes = np.concatenate(lengths).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(docs, kind="stable")
    owners, places = repeated_ranges(sizes[order])
    moved = starts[order][owners] + places
    flags = np.empty(len(symbols), bool)
    flags[moved] = parse(symbols[moved], sizes[order], docs[order])[0]
    ends = np.cumsum([int(n.sum()) for n in lengths])
    bits = [np.packbits(flags[b - n : b]).tobytes() for b, n in zip(ends, np.diff(ends, prepend=0))]
    return pa.Table.from_arrays(
        [rows.column("slice_id"), rows.column("block"), pa.array(bits, pa.binary())], names=["slice_id", "block", "bits"])


def parse(symbols: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Factor stretches greedily against the stretches of smaller documents.

    The stretches come in the order of their documents. Returns a flag per symbol that lies in a factor,
    and the factors as rows of first symbol, source symbol and length.
    """
    n = len(symbols)
    ranked = np.argsort(symbols, kind="stable")
    new = np.ones(n, bool)
    new[1:] = symbols[ranked[1:]] != symbols[ranked[:-1]]
    source = np.empty(n, np.int64)
    source[ranked] = ranked[new][np.cumsum(new) - 1]  # the first place of each symbol: its smallest document
    end = np.repeat(np.cumsum(sizes), sizes)
    doc = np.repeat(docs, sizes)
    flags = np.zeros(n + 1, np.int32)
    factors = []
    at = (np.cumsum(sizes) - sizes)[sizes > 0]
    while len(at):
        begin = source[at]
        known = doc[begin] < doc[at]
        length = np.ones(len(at), np.int64)
        live = np.flatnonzero(known)
        while len(live):
            here, there = at[live] + length[live], begin[live] + length[live]
            on = (here < end[at[live]]) & (there < end[begin[live]])
            live, here, there = live[on], here[on], there[on]
            live = live[symbols[here] == symbols[there]]
            length[live] += 1
        factors.append(np.stack([at[known], begin[known], length[known]], axis=1))
        flags[at[known]] += 1
        flags[at[known] + length[known]] -= 1
        limit = end[at]
        at = at + length
        at = at[at < limit]
    return np.cumsum(flags[:n]) > 0, np.concatenate(factors) if factors else np.zeros((0, 3), np.int64)


def oracle_sql(window: int = WINDOW) -> str:
    """The result of the query in SQL."""
    return f"""
    WITH docs AS (
        SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {NO_ID}) AS k,
               regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    places AS (SELECT r, k, w, unnest(range(0, len(w) - {window - 1})) AS i FROM docs WHERE len(w) >= {window}),
    windows AS (SELECT r, k, i, array_to_string(w[i + 1 : i + {window}], ' ') AS t FROM places),
    firsts AS (SELECT t, min(k) AS k FROM windows GROUP BY t),
    hits AS (SELECT w.r, w.i FROM windows w JOIN firsts f ON w.t = f.t AND f.k < w.k),
    gone AS (SELECT DISTINCT r, unnest(range(i, i + {window})) AS p FROM hits),
    per_row AS (SELECT r, count(*) AS n, list(p) AS ps FROM gone GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
           sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE
               [w[p + 1] FOR p IN range(0, len(w)) IF NOT list_contains(ps, p)] END, ' ')) AS kept_sha256
    FROM docs LEFT JOIN per_row USING (r)"""
