"""Every query against the SQL it is registered with, at the smallest scale."""

import pytest

import __spark_entry__ as entry
from stalemark.plans.catalog import QUERIES
from stalemark.plans.oracles import ORACLES
from tests.compare import open_tables, spark_rows, sql_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return open_tables(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, tables, name):
    assert spark_rows(entry.queries()[name](spark, SF_DIR)) == sql_rows(tables, entry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() == 1
