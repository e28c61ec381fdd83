"""A log with one row per ``doc_id`` whose changes rewrite only the parts they touch.

Rows lie in folders by a hash of their key. A put, an update, a delete or an expiry finds the folders
it touches, reads those and replaces them (dynamic partition overwrite); the files of all others stay as
they are. A change that was cut off can be repeated: every change gives the same rows a second time.
One writer at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan.operators import predlog as M
from lurescan.operators.tables import remove_folder

#: The rows of a log as they are stored.
LOG_SCHEMA = (
    "doc_id string, url string, original_url string, model string, pred int, proba double, created_us bigint, "
    "is_verified boolean, updated_us bigint"
)


class KeyedLog:
    """The log below ``folder``; ``buckets`` belongs to the folder and is chosen once.

    A bucket should be what one task handles well: the expected keys divided by a million. Keys are unique,
    so no bucket is hot. Rows without doc_id are not stored. A missing folder is an empty log.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, schema: str = LOG_SCHEMA):
        self.spark, self.buckets = spark, buckets
        self.folder = f"{folder.rstrip('/')}/of={buckets}"
        self.schema = T.StructType.fromDDL(schema)
        self.columns = self.schema.fieldNames()

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """The stored rows, of some buckets or of all; only their folders are read."""
        return self._parts(buckets).drop("_bucket")

    def rows_of(self, keys: DataFrame) -> DataFrame:
        """The stored rows of the buckets that the keys of a table fall into."""
        return self.rows(self._touched(keys))

    def put(self, rows: DataFrame) -> list[int]:
        """Keyed put: the newest row per key wins (:func:`predlog.upsert`). Returns the touched buckets.

        Columns that the rows lack are NULL in a new row. Of several rows of one key the newest is put.
        """
        given = rows.filter("doc_id IS NOT NULL")
        full = [F.col(c).cast(f.dataType) if c in rows.columns else F.lit(None).cast(f.dataType)
                for c, f in zip(self.columns, self.schema)]
        given = given.select(*[v.alias(c) for v, c in zip(full, self.columns)])
        touched = self._touched(given)
        if touched:
            self._replace(M.upsert(self.rows(touched), given))
        return touched

    def update(self, updates: DataFrame, as_of_us: Column, order: str | None = None) -> list[int]:
        """Change pred and is_verified of stored rows (:func:`predlog.update_logs`); unknown keys change nothing."""
        useful = updates.filter("doc_id IS NOT NULL AND (pred IS NOT NULL OR is_verified IS NOT NULL)")
        known = self.rows(self._touched(useful)).select("doc_id")
        touched = self._touched(known.join(useful.select("doc_id").distinct(), "doc_id", "left_semi"))
        if touched:
            self._replace(M.update_logs(self.rows(touched), useful, as_of_us, order))
        return touched

    def delete(self, keys: DataFrame) -> list[int]:
        """Remove the rows of the keys of a table."""
        asked = keys.filter("doc_id IS NOT NULL").select("doc_id").distinct()
        known = self.rows(self._touched(asked)).select("doc_id")
        return self._keep(self._touched(known.join(asked, "doc_id", "left_semi")), lambda log: M.delete_logs(log, asked))

    def expire(self, as_of_us: int, ttl_seconds: int = M.TTL_SECONDS) -> list[int]:
        """Remove rows older than the time to live; buckets without one are only asked for their times."""
        at = F.lit(as_of_us).cast("bigint")
        old = self._parts(None).filter(at - F.col("created_us") > ttl_seconds * 1_000_000)
        touched = sorted(r[0] for r in old.select("_bucket").distinct().collect())
        return self._keep(touched, lambda log: M.live_rows(log, at, ttl_seconds))

    def _touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most as many numbers as there are buckets."""
        found = keys.filter("doc_id IS NOT NULL").select(self.bucket().alias("b")).distinct()
        return sorted(r["b"] for r in found.collect())

    def _parts(self, buckets: Iterable[int] | None) -> DataFrame:
        stored = T.StructType([*self.schema.fields, T.StructField("_bucket", T.IntegerType())])
        try:
            found = self.spark.read.schema(stored).parquet(self.folder)
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], stored)
        return found if buckets is None else found.filter(F.col("_bucket").isin(list(buckets)))

    def _replace(self, rows: DataFrame) -> None:
        """Write whole buckets, one file each."""
        placed = rows.select(*self.columns, self.bucket().alias("_bucket"))
        writer = placed.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("_bucket").parquet(self.folder)

    def _keep(self, touched: list[int], kept) -> list[int]:
        """Replace buckets by what is kept of them; a bucket without rows goes with its folder."""
        if touched:
            rows = kept(self.rows(touched))
            left = set(self._touched(rows))
            if left:
                self._replace(rows)
            for b in set(touched) - left:
                remove_folder(self.spark, f"{self.folder}/_bucket={b}")
        return touched
