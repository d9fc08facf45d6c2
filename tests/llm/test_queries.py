"""Registered queries of the operators next to their SQL."""

import pytest

from compare import connect, difference
from driftloom.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    diff, rows = difference(spark, con, QUERIES[name], SQL[name], SF)
    assert diff is None, diff
    assert rows > 0
