"""Delimited text whose quoted fields hold line breaks, read by many tasks per file.

A line break ends a record only outside quotes, which a task that starts in the middle of a file cannot
know. So the quotes of every split are counted first; the parity of the counts before a split tells whether it
starts inside a field. Each split then cuts its own records, and the pieces of the records that cross a
border, two per split at most, are put together.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

# the functions travel with the plan, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a row of a cut split is: a whole record, the end, the inside or the begin of one that crosses a border.
WHOLE, END, INSIDE, BEGIN = range(4)

_CUT = "path string, at bigint, kind int, first boolean, record string"


def read_quoted(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, sep: str = ",", quote: str = '"',
    header: bool = True,
) -> DataFrame:
    """The records of delimited files under a schema; a quote inside a field is doubled.

    Lines end with a line feed, with or without a carriage return before it; both are kept inside quotes.
    Blank lines between records are skipped. Quotes stand around whole fields or doubled inside them: a
    single quote elsewhere opens a field up to the next one. A field that is still open where its file ends
    keeps what there is. With ``header`` the first record of each file is left out. The broadcast table
    of split parities has one small row per split (``spark.sql.files.maxPartitionBytes`` of input).
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
    quotes = F.octet_length("value") - F.octet_length(F.replace("value", F.lit(quote)))
    splits = lines.groupBy("path", "at").agg(F.sum(quotes).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("path").orderBy("at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    odd = splits.select("path", "at", (before % 2 == 1).alias("inside")).filter("inside")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _records(batches, quote)

    known = lines.join(F.broadcast(odd), ["path", "at"], "left").select(
        "value", "path", "at", F.coalesce("inside", F.lit(False)).alias("inside"))
    pieces = known.mapInArrow(cut, _CUT)
    whole = pieces.filter(F.col("kind") == WHOLE).select("first", "record")
    records = whole.unionByName(_joined(pieces.filter(F.col("kind") != WHOLE)))
    if header:
        records = records.filter("NOT first")
    options = {"sep": sep, "quote": quote, "escape": quote, "multiLine": "true"}
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return records.select(F.from_csv("record", ddl, options).alias("row")).select("row.*")


def _joined(pieces: DataFrame) -> DataFrame:
    """Records that cross a border: a begin, what lies inside, and an end, in the order of the file."""
    order = W.partitionBy("path").orderBy("at", "kind")
    number = F.sum((F.col("kind") == BEGIN).cast("int")).over(order)
    parts = F.array_sort(F.collect_list(F.struct("at", "kind", "record")))
    return (
        pieces.withColumn("number", number)
        .groupBy("path", "number")
        .agg(F.max("first").alias("first"), parts.alias("parts"))
        .select("first", F.array_join(F.col("parts")["record"], "\n").alias("record"))
        .filter("trim(record) != ''")
    )


def _records(batches: Iterator[pa.RecordBatch], quote: str) -> Iterator[pa.RecordBatch]:
    """Cut the lines of each split, which come in order, into records and border pieces."""
    split, cutter = None, None
    for batch in batches:
        paths, starts = batch.column(1).to_pylist(), batch.column(2).to_numpy()
        edge = np.flatnonzero([(p, s) != (q, r) for p, s, q, r in zip(paths[1:], starts[1:], paths, starts)]) + 1
        for a, b in zip([0, *edge], [*edge, batch.num_rows]):
            if a == b:
                continue
            here = (paths[a], int(starts[a]))
            if here != split:
                if cutter is not None:
                    yield from cutter.close()
                split, cutter = here, _Cutter(*here, bool(batch.column(3)[a].as_py()))
            yield from cutter.add(batch.column(0).slice(a, b - a), quote)
    if cutter is not None:
        yield from cutter.close()


class _Cutter:
    """The lines of one split so far: those of the record that is open."""

    def __init__(self, path: str, at: int, inside: bool):
        self.path, self.at = path, at
        self.open: list[str] = []
        self.inside = self.crossed = inside
        self.first = at == 0

    def add(self, lines: pa.Array, quote: str) -> Iterator[pa.RecordBatch]:
        lines = lines.fill_null("")
        turns = np.cumsum(pc.count_substring(lines, quote).to_numpy(zero_copy_only=False)) + self.inside
        ends = turns % 2 == 0
        starts = np.concatenate([[not self.inside], ends[:-1]])
        single = starts & ends
        records = []
        values = lines.to_pylist()
        for i in np.flatnonzero(~single).tolist():  # lines of records with line breaks
            self.open.append(values[i])
            if ends[i]:
                records.append((i, END if self.crossed else WHOLE, "\n".join(self.open)))
                self.open, self.crossed = [], False
        self.inside = bool(turns[-1] % 2)
        plain = np.flatnonzero(single).tolist()
        rows = sorted([*records, *((i, WHOLE, values[i]) for i in plain)])
        kinds = [k for _, k, _ in rows]
        # the last break of a record is outside quotes, so what stands before a line feed belongs to it
        texts = [t.removesuffix("\r") for _, _, t in rows]
        kept = [j for j, (k, t) in enumerate(zip(kinds, texts)) if k != WHOLE or t.strip(" \t")]
        if kept:
            yield self._rows([kinds[j] for j in kept], [texts[j] for j in kept])

    def close(self) -> Iterator[pa.RecordBatch]:
        """What is open at the end of the split goes on in the next one."""
        if self.open:
            yield self._rows([INSIDE if self.crossed else BEGIN], ["\n".join(self.open)])

    def _rows(self, kinds: list[int], texts: list[str]) -> pa.RecordBatch:
        n = len(kinds)
        first = np.zeros(n, bool)
        heads = [j for j, k in enumerate(kinds) if k in (WHOLE, BEGIN)]
        if self.first and heads:
            first[heads[0]], self.first = True, False
        return pa.RecordBatch.from_arrays([
            pa.array([self.path] * n, pa.string()), pa.array([self.at] * n, pa.int64()), pa.array(kinds, pa.int32()),
            pa.array(first), pa.array(texts, pa.string())], names=["path", "at", "kind", "first", "record"])
