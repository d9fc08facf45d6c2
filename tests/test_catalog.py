import pytest

import __spark_entry__ as entry
from compare import connect, difference
from driftloom.catalog import all_queries, all_sql

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() == 1000
    assert "composite" in df.columns


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_sql_is_there():
    assert set(all_queries()) == set(all_sql())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    diff, rows = difference(spark, con, all_queries()[name], all_sql().get(name), SF)
    assert diff is None, diff
    assert rows > 0
