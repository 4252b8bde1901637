"""Every query with a SQL equivalent, row for row, on the smallest tables."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
ORACLES = entry_points.oracle_sql()
QUERIES = entry_points.queries()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, name, QUERIES[name], ORACLES[name], FOLDER) is None


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry_points.entry(spark).count() == 6
