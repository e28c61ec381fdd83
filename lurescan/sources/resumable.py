"""Resumable builds: the output is partitioned by chunk, and finished chunks are not built again.

:func:`build_resumable` finds the missing chunks by what has been written. :func:`run_build` is a stream over
staged chunks: Spark's own checkpoint is the resume point, and the rate of the source is the size of a step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lurescan.operators.tables import cut_lineage


def finished_chunks(spark: SparkSession, folder: str) -> DataFrame | None:
    """chunk_id of the partitions that have been committed."""
    try:
        return spark.read.parquet(folder).select("chunk_id").distinct()
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def build_resumable(
    rows: DataFrame,
    build: Callable[[DataFrame], DataFrame],
    folder: str,
    index: str = "row_idx",
    step: int = 100_000,
    writes: int = 16,
    rowwise: bool = False,
) -> int:
    """Build the missing chunks and return how many writes that took.

    A chunk is ``step`` consecutive row numbers. The missing ones are built in at most ``writes`` writes,
    however many there are. Each replaces exactly its partitions, so a write that was cut off is
    repeated as a whole and at most that share of the work is lost. ``build`` keeps the ``chunk_id``
    column and gives every input row back, usable or with a reason.

    The rows of a write lie in few splits of the input, so they are dealt out by chunk before ``build``. With
    ``rowwise``, for a ``build`` that moves no row to another task, they are written where they are; otherwise
    the built rows are dealt out again.
    """
    chunked = rows.withColumn("chunk_id", F.floor(F.col(index) / step).cast("int"))
    done = finished_chunks(rows.sparkSession, folder)
    # the finished chunks are looked up once, not in every write
    todo = chunked if done is None else chunked.join(cut_lineage(done), "chunk_id", "left_anti")
    bounds = todo.agg(F.min("chunk_id").alias("low"), F.max("chunk_id").alias("high")).first()
    if bounds["low"] is None:
        return 0
    size = -(-(bounds["high"] + 1 - bounds["low"]) // writes)
    starts = range(bounds["low"], bounds["high"] + 1, size)
    for start in starts:
        # on the row number itself, so that the range reaches the scan
        wave = todo.filter((F.col(index) >= start * step) & (F.col(index) < (start + size) * step))
        write_chunks(build(wave.repartition("chunk_id")), folder, placed=rowwise)
    return len(starts)


def write_chunks(rows: DataFrame, folder: str, placed: bool = False) -> None:
    """Replace the chunks that the rows have. A chunk is written by one task, as one file.

    ``placed``: the rows of a chunk lie in one partition already.
    """
    writer = (rows if placed else rows.repartition("chunk_id")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("chunk_id").parquet(folder)


def stage_chunks(rows: DataFrame, folder: str, index: str = "row_idx", step: int = 100_000) -> None:
    """Lay the rows out by chunk of ``step`` consecutive row numbers, one file each, as input of :func:`run_build`.

    Chunks that are staged already stay as they are, so a call that was cut off is repeated, and rows
    that come later are added by the next call if they begin a new chunk. Rows without a number are
    left out.
    """
    chunked = rows.filter(F.col(index).isNotNull()).withColumn("chunk_id", F.floor(F.col(index) / step).cast("int"))
    done = finished_chunks(rows.sparkSession, _staged(folder))
    write_chunks(chunked if done is None else chunked.join(done, "chunk_id", "left_anti"), _staged(folder))


def _staged(folder: str) -> str:
    return f"{folder}/staged"


def run_build(
    spark: SparkSession, schema: T.StructType, folder: str, build: Callable[[DataFrame], DataFrame],
    chunks_per_batch: int = 16,
) -> StreamingQuery:
    """Build the staged chunks that no earlier run has built; :func:`built` reads the result.

    ``schema`` is that of the staged rows, without chunk_id. The staged files are a stream of
    ``chunks_per_batch`` chunks a batch, and its checkpoint below ``folder`` knows which are done. A batch
    that was cut off is built again as a whole and replaces its own chunks, so at most one batch of work
    is lost and no chunk that is finished is built again. ``build`` keeps the ``chunk_id`` column.
    """
    def process(batch: DataFrame, batch_id: int) -> None:
        write_chunks(build(batch), f"{folder}/built")

    fields = T.StructType([*(f for f in schema.fields if f.name != "chunk_id"), T.StructField("chunk_id", T.IntegerType())])
    return (
        spark.readStream.schema(fields).option("maxFilesPerTrigger", chunks_per_batch).parquet(_staged(folder))
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def built(spark: SparkSession, folder: str) -> DataFrame:
    """What :func:`run_build` has written."""
    return spark.read.parquet(f"{folder}/built")
