"""A build as a stream over chunks: cut off, continued, extended."""

import glob

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lurescan.sources import resumable


def rows_of(spark, n):
    return spark.range(n).select(F.col("id").alias("row_idx"), F.concat(F.lit("u"), "id").alias("url")).repartition(8)


def test_cut_off_and_continued(spark, tmp_path):
    folder, seen, stop = str(tmp_path / "b"), [], [True]
    rows = rows_of(spark, 1050)

    def build(batch):
        seen.append(sorted(r[0] for r in batch.select("chunk_id").distinct().collect()))
        if stop[0] and len(seen) == 3:
            raise RuntimeError("cut off")
        return batch.withColumn("n", F.length("url"))

    resumable.stage_chunks(rows, folder, step=100)
    assert len(glob.glob(f"{folder}/staged/chunk_id=*/*.parquet")) == 11
    with pytest.raises(StreamingQueryException):
        resumable.run_build(spark, rows.schema, folder, build, 2).awaitTermination()
    first = {c for chunks in seen[:2] for c in chunks}
    assert len(first) == 4 and resumable.built(spark, folder).select("chunk_id").distinct().count() == 4
    stop[0] = False
    resumable.run_build(spark, rows.schema, folder, build, 2).awaitTermination()
    assert seen[3] == seen[2]  # the batch that was cut off
    again = [c for chunks in seen[3:] for c in chunks]
    assert len(again) == len(set(again)) and first.isdisjoint(again) and first | set(again) == set(range(11))
    done = resumable.built(spark, folder)
    assert done.count() == 1050 and done.select("row_idx").distinct().count() == 1050
    assert len(glob.glob(f"{folder}/built/chunk_id=*/*.parquet")) == 11
    resumable.run_build(spark, rows.schema, folder, build, 2).awaitTermination()
    assert len(seen) == 3 + 4  # nothing was left to do


def test_later_chunks_are_added(spark, tmp_path):
    folder, calls = str(tmp_path / "b"), []
    rows = rows_of(spark, 500)

    def build(batch):
        calls.append(1)
        return batch

    for part in (rows.filter("row_idx < 200"), rows, rows):
        resumable.stage_chunks(part, folder, step=100)
        resumable.run_build(spark, rows.schema, folder, build, 100).awaitTermination()
    assert len(calls) == 2 and resumable.built(spark, folder).count() == 500


def test_rows_without_number_and_no_rows(spark, tmp_path):
    folder = str(tmp_path / "b")
    rows = rows_of(spark, 50).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS row_idx, 'x' AS url"))
    resumable.stage_chunks(rows, folder, step=100)
    resumable.run_build(spark, rows.schema, folder, lambda b: b).awaitTermination()
    assert resumable.built(spark, folder).count() == 50


def test_waves_write_one_file_per_chunk(spark, tmp_path):
    folder = str(tmp_path / "w")
    resumable.build_resumable(rows_of(spark, 1000), lambda part: part, folder, step=100, writes=3)
    assert len(glob.glob(f"{folder}/chunk_id=*/*.parquet")) == 10


def test_finished_chunks_are_read_once(spark, tmp_path):
    folder, source, read = str(tmp_path / "w"), str(tmp_path / "rows"), []
    rows_of(spark, 1000).write.parquet(source)
    rows = spark.read.parquet(source)

    def build(part):
        read.extend(part.inputFiles())
        return part

    resumable.build_resumable(rows.filter("row_idx < 400"), build, folder, step=100, writes=2)
    assert resumable.build_resumable(rows, build, folder, step=100, writes=3) == 3
    assert read and not [f for f in read if f"{folder}/" in f]  # no write reads what the others have written
    assert spark.read.parquet(folder).count() == 1000


def test_rowwise_build_moves_the_input_only(spark, tmp_path):
    folder, tasks = str(tmp_path / "w"), []

    def build(part):
        places = part.withColumn("task", F.spark_partition_id())
        tasks.append(places.groupBy("chunk_id").agg(F.countDistinct("task").alias("n")).agg(F.max("n")).first()[0])
        return part.withColumn("word", F.explode(F.split(F.lit("a b c"), " ")))

    rows = rows_of(spark, 1000)
    resumable.build_resumable(rows, build, folder, step=100, writes=3, rowwise=True)
    assert tasks == [1, 1, 1]  # the rows of a chunk meet before the build
    assert len(glob.glob(f"{folder}/chunk_id=*/*.parquet")) == 10
    done = spark.read.parquet(folder)
    assert done.count() == 3000 and done.select("row_idx").distinct().count() == 1000
