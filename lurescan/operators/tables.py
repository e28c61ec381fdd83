"""Helpers for joins with small tables and for numbering rows without a global sort."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir`` or by ``setCheckpointDir``. Only a local session
    may fall back to a temporary folder, which it then sets.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    folder = getattr(shared_folder, "_local", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        shared_folder._local = folder
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for row-wise work on an input with fewer splits than cores.

    A large input has many splits and is left alone, so nothing is shuffled at scale.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Parts of a split whose rows become many rows each.
PARTS_PER_SPLIT = 16


def grouped_by_key(df: DataFrame, key: str) -> DataFrame:
    """The rows of a key in one partition, in partitions that are a fraction of a split.

    For rows that are exploded next and then grouped or ordered by the key: the narrow rows are shuffled once,
    the many long ones not at all, and a partition of them is sorted in memory. The rows of one key meet
    in one task, as they do in a window over the key.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(cores, PARTS_PER_SPLIT * df.rdd.getNumPartitions()), key)


def cut_lineage(df: DataFrame, folder: str | None = None) -> DataFrame:
    """A small table computed once: a reliable checkpoint, or a table below ``folder``.

    Spark removes checkpoints with ``spark.cleaner.referenceTracking.cleanCheckpoints``; a caller that
    runs for ever gives a folder and removes it (:func:`remove_folder`).
    """
    if folder is None:
        shared_folder(df.sparkSession)
        return df.checkpoint(eager=True)
    path = f"{folder}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a scratch folder in whatever file system holds it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Rows without a key are dealt over so many values.
NULL_SALTS = 1 << 20


def same(*columns: str) -> Column:
    """Null-safe equality of ``left`` and ``right`` on the columns."""
    match = F.lit(True)
    for c in columns:
        match = match & F.col(f"left.{c}").eqNullSafe(F.col(f"right.{c}"))
    return match


def attach(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Join with a per-group table; NULL is a group like any other.

    The table has one row per group. Adaptive execution broadcasts it by its real size, or splits
    a group with many rows.
    """
    added = [c for c in small.columns if c not in on]
    joined = big.alias("left").join(small.alias("right"), same(*on), how)
    return joined.select("left.*", *[F.col(f"right.{c}") for c in added])


def hot_keys(
    df: DataFrame, key: str, rows_per_task: int = ROWS_PER_TASK, folder: str | None = None
) -> DataFrame:
    """``_hot, _salts``: the keys with more rows than a task should get, and the tasks they need.

    There are fewer than rows / ``rows_per_task`` of them. The count reads the key column alone. It is part
    of the plan that uses it, no job of its own; with ``folder`` it is stored there first, for callers that
    use it in many plans.
    """
    counts = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    hot = counts.filter(F.col("_n") > rows_per_task)
    salts = F.ceil(F.col("_n") / rows_per_task).cast("int").alias("_salts")
    found = hot.select("_hot", salts)
    return found if folder is None else cut_lineage(found, folder)


def join_split_hot(
    big: DataFrame, small: DataFrame, key: str, how: str = "left", condition: Column | None = None,
    hot: DataFrame | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Equi join on one key with the rows of a hot key of ``big`` spread over as many tasks as it needs.

    The rows of a hot key are spread by a hash, and its few rows of ``small`` are repeated once per
    salt. Rows without a key match nothing and are spread over all tasks. This does not rely on adaptive
    execution, which streams may switch off. ``condition`` may restrict the pairs further; columns
    other than the key must differ. ``hot`` passes the table of :func:`hot_keys` if it is known.
    """
    if how not in ("left", "inner", "left_anti"):
        raise ValueError(f"unsupported join {how}")
    hot = F.broadcast(hot_keys(big, key, rows_per_task) if hot is None else hot)
    plain = [f.name for f in big.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    salts = F.when(F.col(key).isNull(), NULL_SALTS).otherwise(F.coalesce("_salts", F.lit(1)))
    salted = big.join(hot, F.col(key) == F.col("_hot"), "left").withColumn(
        "_salt", F.pmod(F.xxhash64(*plain), salts).cast("int")
    ).drop("_hot", "_salts")
    other = small.withColumnRenamed(key, "_join_key").filter(F.col("_join_key").isNotNull())
    other = other.join(hot, F.col("_join_key") == F.col("_hot"), "left")
    copies = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    other = other.withColumn("_small_salt", F.explode(copies)).drop("_hot", "_salts")
    match = (F.col(key) == F.col("_join_key")) & (F.col("_salt") == F.col("_small_salt"))
    if condition is not None:
        match = match & condition
    return salted.join(other, match, how).drop("_join_key", "_salt", "_small_salt")


def write_bucketed(df: DataFrame, key: str, name: str, folder: str, buckets: int) -> DataFrame:
    """Store a table with one row per key below ``folder`` as the table ``name``, bucketed and sorted by the key.

    One file a bucket. :func:`join_bucketed` joins it without shuffling or sorting it again.
    """
    placed = df.filter(F.col(key).isNotNull()).repartition(buckets, key)
    placed.write.bucketBy(buckets, key).sortBy(key).option("path", folder).saveAsTable(name)
    return df.sparkSession.table(name)


def join_bucketed(big: DataFrame, table: DataFrame, key: str, hot: DataFrame | None = None) -> DataFrame:
    """Left join with a table of :func:`write_bucketed`, which is read bucket by bucket.

    The rows of hot keys get their record from a broadcast of the few hot records; like the rows without a key
    they go by a string of their own that no record has, so they are spread over all buckets.
    """
    hot = hot_keys(big, key) if hot is None else hot
    added = [c for c in table.columns if c != key]
    record = F.struct(*[F.col(c) for c in added])
    few = table.join(F.broadcast(hot), F.col(key) == F.col("_hot")).select("_hot", record.alias("_hot_record"))
    plain = [f.name for f in big.schema.fields if not f.dataType.simpleString().startswith(("map", "variant"))]
    apart = F.concat(F.lit("\0"), F.pmod(F.xxhash64(*plain), F.lit(NULL_SALTS)).cast("string"))
    cold = F.when(F.col("_hot").isNull(), F.col(key))
    # fewer than rows / rows_per_task records
    parted = big.join(F.broadcast(few), F.col(key) == F.col("_hot"), "left").withColumn(
        "_bucket_key", F.coalesce(cold, apart))
    other = table.select(F.col(key).alias("_join_key"), record.alias("_record"))
    joined = parted.join(other, F.col("_bucket_key") == F.col("_join_key"), "left")
    found = F.coalesce("_hot_record", "_record")
    return joined.select(*big.columns, *[found[c].alias(c) for c in added])


def ordered_parts(df: DataFrame, order: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Add ``_part``: ranges of a column with about ``rows_per_task`` rows each, in its order.

    Spark's range partitioner finds the cuts from a sample of every split. The input is computed once,
    and the result is stored, so that every reader sees the same parts. NULL comes first.
    """
    df = cut_lineage(df)
    parts = max(1, -(-df.count() // rows_per_task))
    ranged = df.repartitionByRange(parts, F.col(order).asc_nulls_first())
    return cut_lineage(ranged.withColumn("_part", F.spark_partition_id()))


def running_totals(
    df: DataFrame, order: str, sums: dict[str, str], descending: bool = False, rows_per_task: int = ROWS_PER_TASK,
    ties: Sequence[str] = (),
) -> DataFrame:
    """Running sums over a globally ordered column; ``ties`` order the rows of one value.

    Each part of the order (see :func:`ordered_parts`) is summed on its own, and the totals of the
    parts before it are added. No task sees more than one part; the totals are one row per part.
    ``<name>_total`` holds the sum over all rows.
    """
    numbered = ordered_parts(df, order, rows_per_task)
    totals = numbered.groupBy("_part").agg(
        *[F.sum(source).alias(f"_before_{name}") for name, source in sums.items()]
    )
    key = F.col("_part").desc() if descending else F.col("_part").asc()
    earlier = W.orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(key).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    offsets = totals.select(
        "_part",
        *[
            F.coalesce(F.sum(f"_before_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}")
            for name in sums
        ],
        *[F.sum(f"_before_{name}").over(everything).alias(f"{name}_total") for name in sums],
    )
    inner = W.partitionBy("_part").orderBy(
        F.col(order).desc() if descending else F.col(order).asc(), *ties
    ).rowsBetween(W.unboundedPreceding, 0)
    # one row per part
    joined = numbered.join(F.broadcast(offsets), "_part")
    return joined.select(
        *df.columns,
        *[
            (F.sum(source).over(inner) + F.col(f"_before_{name}")).alias(name)
            for name, source in sums.items()
        ],
        *[f"{name}_total" for name in sums],
    )


def with_row_number(df: DataFrame, order: str, name: str = "row_idx", ties: Sequence[str] = ()) -> DataFrame:
    """0-based global position by an order column; ``ties`` order the rows of one value."""
    numbered = running_totals(df.withColumn("_one", F.lit(1)), order, {"_n": "_one"}, ties=ties)
    return numbered.withColumn(name, F.col("_n") - 1).drop("_one", "_n", "_n_total")


def missing(column: str, dtype: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    null = F.col(column).isNull()
    return null | F.isnan(column) if dtype in ("double", "float") else null
