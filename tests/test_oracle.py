"""Every registered query against DuckDB on the smallest tables."""

import pytest
from compare import difference, duck, duck_rows, spark_rows

import __spark_entry__ as contract
from talkweave.plans.catalog import QUERIES, SQL


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, con, name):
    got = spark_rows(QUERIES[name](spark, sf))
    assert difference(got, duck_rows(con, SQL[name])) is None


def test_entry(spark):
    assert contract.entry(spark).count() == 2
