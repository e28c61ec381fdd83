"""Queries with an SQL twin on a table with NULLs, repeated rows and long texts."""

import duckdb
import pytest
from compare import differences
from lurescan.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_edge_rows_equal_the_sql(spark, edge, none, tmp_path, name):
    items = [(1, "Alpha BETA gamma."), (2, "one"), (3, ""), (4, None), (None, "beta"), (12, "alpha beta gamma"), (6, "wordy " * 12)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    turns = [(i % 7 if i % 9 else None, i % 4 if i % 5 else None, ["user", None, ""][i % 3], [None, "é", "b"][i % 3]) for i in range(80)]
    talks = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    for place, (docs, conversations) in enumerate(((edge, talks), (none, talks.limit(0)))):
        folder = f"{tmp_path}/{place}"
        docs.coalesce(1).write.parquet(f"{folder}/documents.parquet")
        benchmark.coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
        conversations.coalesce(1).write.parquet(f"{folder}/conversations.parquet")
        con = duckdb.connect()
        for table in ("documents", "benchmark", "conversations"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
        problem = differences(queries.QUERIES[name](spark, folder), con, queries.ORACLES[name])
        assert problem is None, problem
