"""Every SQL-checked query against its DuckDB oracle on the smallest tables (sf0.001)."""

import pytest

import __spark_entry__ as E
from conftest import SF_TINY
from oracle_check import compare, duck

ORACLES = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_TINY)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, name, E.queries()[name], ORACLES[name], SF_TINY, con)
    assert res["status"] == "ok", res
