"""Every llm query with SQL against DuckDB on the smallest tables."""

import pytest
from conftest import SF_TINY
from oracle_check import compare, duck

from flawscope.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, name):
    res = compare(spark, name, QUERIES[name], ORACLES[name], SF_TINY, duck(SF_TINY))
    assert res["status"] == "ok" and not res.get("types"), res


def test_one_query_per_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in QUERIES
