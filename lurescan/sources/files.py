"""Readers and writers of URL lists, feature tables, brand lists and evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescan import schemas
from lurescan.sources.quoted import read_quoted

BOM = "\ufeff"
CORRUPT = "_corrupt_record"
MOST_RULES = 100_000


def read_url_list(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Labelled URL list: ``;`` between fields, ``"`` around them.

    A quoted field may hold line breaks, and a file is read by many tasks (:mod:`lurescan.sources.quoted`).
    Without ``multi_line`` every line is a record, which saves counting the quotes of a list without breaks.
    """
    if multi_line:
        return read_quoted(spark, path, schemas.URL_LIST, sep=";")
    return spark.read.csv(path, schema=schemas.URL_LIST, sep=";", quote='"', escape='"', header=True)


def read_table(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """Feature table with a header line; a byte-order mark before it is dropped. All text."""
    df = spark.read.csv(path, sep=sep, header=True, quote='"', escape='"')
    return df.withColumnRenamed(df.columns[0], df.columns[0].lstrip(BOM).strip('"'))


def read_tolerant(
    spark: SparkSession, path: str, schema: T.StructType | str, sep: str = ";"
) -> DataFrame:
    """Skip the lines that do not fit the schema."""
    return spark.read.csv(path, schema=schema, sep=sep, header=True, mode="DROPMALFORMED")


def read_with_audit(
    spark: SparkSession, path: str, schema: T.StructType, sep: str = ";"
) -> DataFrame:
    """Keep all lines; ``_corrupt_record`` holds the text of a line that does not fit."""
    audited = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.csv(
        path, schema=audited, sep=sep, header=True, mode="PERMISSIVE",
        columnNameOfCorruptRecord=CORRUPT,
    )


def read_parts(spark: SparkSession, folder: str, sep: str = ";") -> DataFrame:
    """All part files of a folder as one table, with the union of their columns.

    ``part_file`` keeps the name order. One job finds the header line of every file; files with the
    same header are read together.
    """
    lines = spark.read.option("pathGlobFilter", "*.csv").text(folder)
    heads = (
        lines.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"))
        .filter("at = 0")
        .withColumn("place", F.monotonically_increasing_id())
        .groupBy("path")
        .agg(F.min_by("value", "place").alias("header"))
    )
    by_header: dict[str, list[str]] = {}
    for row in heads.orderBy("path").collect():
        by_header.setdefault(row["header"], []).append(row["path"])
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]*)$", 1)
    parts = [
        read_table(spark, group, sep).withColumn("part_file", name) for group in by_header.values()
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged


def write_table(df: DataFrame, path: str, sep: str = ",", bom: bool = False) -> None:
    """CSV with a header line, optionally with a byte-order mark before it."""
    first = df.columns[0]
    marked = df.withColumnRenamed(first, BOM + first) if bom else df
    marked.write.mode("overwrite").csv(path, sep=sep, header=True, quote='"', escape='"')


def read_brands(spark: SparkSession, path: str) -> DataFrame:
    """One brand per line, trimmed; no blanks, no repeats."""
    return (
        spark.read.text(path)
        .select(F.trim("value").alias("brand"))
        .filter("brand != ''")
        .distinct()
    )


def read_suffix_rules(spark: SparkSession, path: str) -> list[str]:
    """Public-suffix rules from a published list; comments and blank lines are left out.

    The rules become part of the plan, so a list of more than ``MOST_RULES`` is refused; a list of any
    length is a table (:func:`read_suffix_table`).
    """
    rules = read_suffix_table(spark, path).limit(MOST_RULES + 1).collect()
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} suffix rules")
    return [r["rule"] for r in rules]


def read_suffix_table(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a published suffix list as a table with the column ``rule``."""
    lines = spark.read.text(path).select(F.trim("value").alias("rule"))
    return lines.filter("rule != '' AND NOT rule LIKE '//%'")


def save_sets(sets: dict[str, DataFrame], folder: str) -> None:
    """Prepared train and test sets, one parquet table each."""
    for name, df in sets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_sets(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def write_results(results: dict[str, DataFrame], folder: str, fmt: str = "csv") -> None:
    """Evaluation tables as CSV or JSON."""
    for name, df in results.items():
        writer = df.write.mode("overwrite")
        if fmt == "json":
            writer.json(f"{folder}/{name}")
        else:
            writer.csv(f"{folder}/{name}", header=True)
