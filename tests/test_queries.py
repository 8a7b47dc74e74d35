"""Every query that has SQL equals it on the smallest tables."""

import pytest
from oracle import compare, connect

from tabweft import catalogue

SF = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_all_sql_has_a_query():
    assert set(SQL) <= set(catalogue.queries())


@pytest.mark.parametrize("name", list(SQL))
def test_equals_sql(spark, con, name):
    assert compare(spark, con, SF, catalogue.queries()[name], SQL[name]) is None
