"""Registered queries: one Spark job each and, where SQL can say it, the same result in SQL.

The column list of a query is declared once (``"url:s n:i share:d"``) and applied to both sides:
``s`` text, ``i`` whole number, ``d`` double rounded to six places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
COLUMNS: dict[str, str] = {}

_SPARK = {
    "s": lambda c: F.col(c).cast("string"),
    "i": lambda c: F.col(c).cast("bigint"),
    "d": lambda c: F.round(F.col(c).cast("double"), 6),
}
_SQL = {
    "s": 'CAST("{c}" AS VARCHAR) AS "{c}"',
    "i": 'CAST("{c}" AS BIGINT) AS "{c}"',
    "d": 'round(CAST("{c}" AS DOUBLE), 6) AS "{c}"',
}


class Tables:
    """The given parquet tables by attribute."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def parse_columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(item.split(":")) for item in spec.split()]


def query(name: str, columns: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its output columns and the SQL twin."""
    pairs = parse_columns(columns)

    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Tables(spark, sf_dir))
            return df.select(*[_SPARK[kind](c).alias(c) for c, kind in pairs])

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        COLUMNS[name] = columns
        if sql is not None:
            chosen = ", ".join(_SQL[kind].format(c=c) for c, kind in pairs)
            ORACLES[name] = f"SELECT {chosen} FROM (\n{sql.strip()}\n) AS result"
        return fn

    return register
