"""Every query against its SQL, on the smallest data."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return database(SF)


LIBRARY = [name for group in entry.LIBRARY for name in group.QUERIES]


@pytest.mark.parametrize("name", LIBRARY)
def test_query_agrees_with_sql(spark, con, name):
    verdict, rows, _ = compare(spark, con, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert verdict in ("ok", "rows only"), verdict


def test_every_query_has_sql():
    assert set(LIBRARY) <= set(entry.oracle_sql())


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0
