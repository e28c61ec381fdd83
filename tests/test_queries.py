"""Every registered query against its SQL twin on the smallest tables."""

import pytest

import __spark_entry__ as entry
from compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    problem = differences(df, con, entry.oracle_sql()[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert len(df.columns) == 140
    assert df.columns[0] == "url" and df.columns[-1] == "label"


def test_plans_read_only_what_they_need(spark):
    plan = entry.queries()["url_entropy"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan
