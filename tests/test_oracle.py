"""Every registered query against its SQL in DuckDB."""

import pytest

from oracle_check import compare, connect

import __spark_entry__ as contract

SQL = contract.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, sf_dir, name):
    build = contract.queries()[name]
    if name in SQL:
        assert compare(spark, con, sf_dir, name, build, SQL[name]) is None
    else:
        assert build(spark, sf_dir).count() > 0


def test_every_sql_belongs_to_a_query():
    assert set(SQL) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() == 1
