"""Every query with SQL equals it on the smallest tables."""

import pytest

import __spark_entry__ as entry
from oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_query_is_callable_and_every_oracle_has_one():
    assert set(SQL) <= set(entry.queries()) and all(callable(f) for f in entry.queries().values())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, FOLDER), SQL[name], con) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0
