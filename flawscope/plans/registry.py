"""Registry of named queries: each takes (spark, sf_dir) and returns a DataFrame.

A query registered with ``sql=...`` is checked against DuckDB on the same parquet tables;
without it only the row count is compared (model fits, random draws).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def r6(c: Column) -> Column:
    """Round to 6 decimals and fold -0.0 into 0.0 (same rule in the oracle SQL)."""
    return F.round(c, 6) + F.lit(0.0)


def sql_r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"
