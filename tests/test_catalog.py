"""Every registered query with SQL against it, on the smallest driver tables."""

import pytest

import __spark_entry__ as driver
from oracle_check import connect, differences
from tripleloom import catalog

SF = "/root/testdata/sf0.001"
QUERIES, SQL = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(catalog.QUERIES) <= set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, con, name):
    problem, rows = differences(spark, con, name, QUERIES[name], SQL[name], SF)
    assert not problem and rows


def test_entry(spark):
    frame = driver.entry(spark)
    assert frame.columns == ["p", "o_kind", "triples"] and frame.count() > 0
