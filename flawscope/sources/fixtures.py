"""Stand-in tables derived from the generated TPC-H-like tables.

The SQL text here is shared by the Spark queries (``spark.sql`` over temp views) and the
DuckDB oracles (as the first CTE), so both engines start from the same rows.

* ``wide``     - production stand-in: one row per order, stations 1-7 x four measurements,
                 structural nulls, 0/1 ``response``.
* ``classify`` - census stand-in: padded strings, ``?`` and empty-string sentinels.
* ``cluster``  - arrests stand-in: 25 rows, 4 numeric columns (fixed size: tests only).
* ``customers``- the same shape per customer (grows with the data): clustering queries.
* ``pred``     - fixed predictions for the metric operators.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from flawscope.sources.tables import TABLES, load_table

STATIONS = range(1, 8)
# Measurement name -> lineitem column
MEASURES = (("qty", "l_quantity"), ("price", "l_extendedprice"), ("disc", "l_discount"),
            ("tax", "l_tax"))

WIDE_FEATURES = [f"s{s}_{m}" for s in STATIONS for m, _ in MEASURES]


def _wide_sql() -> str:
    cols = ",\n       ".join(
        f"max(CASE WHEN l_linenumber = {s} THEN {src} END) AS s{s}_{m}"
        for s in STATIONS for m, src in MEASURES
    )
    return (
        "SELECT l_orderkey AS id,\n       " + cols + ",\n"
        "       max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS response\n"
        "FROM lineitem GROUP BY l_orderkey"
    )


WIDE_SQL = _wide_sql()

CLASSIFY_SQL = """SELECT CASE WHEN o_orderkey % 17 = 0 THEN ' ?' ELSE concat(' ', o_orderpriority, ' ') END AS priority,
       CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE c_mktsegment END AS segment,
       o_orderstatus AS status, n_name AS nation,
       CAST(o_orderkey % 100 AS INT) AS age, CAST(o_orderkey % 97 AS INT) AS hours,
       CASE WHEN o_orderkey % 10 = 0 THEN CAST(floor(o_totalprice) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS gain,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(floor(o_totalprice / 7) AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS loss,
       CASE WHEN o_totalprice > 250000 THEN '>250K' ELSE '<=250K' END AS high_value
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""

CLUSTER_SQL = """SELECT n_name AS city, count(*) AS customers, round(avg(c_acctbal), 4) AS balance,
       round(max(c_acctbal), 4) AS max_balance, round(avg(o.total), 4) AS spend
FROM customer JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
           FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey
GROUP BY n_name"""

CUSTOMERS_SQL = """SELECT c_custkey AS id, c_acctbal AS balance, coalesce(o.n, 0) AS orders,
       coalesce(o.total, CAST(0 AS DOUBLE)) AS spend, coalesce(o.top, CAST(0 AS DOUBLE)) AS max_order
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n,
                                CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
                                max(o_totalprice) AS top
                         FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"""

PRED_SQL = """SELECT l_orderkey, l_linenumber, l_linestatus,
       CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS label,
       CAST(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS DOUBLE) AS prediction,
       l_quantity AS score
FROM lineitem"""

FIXTURE_SQL = {"wide": WIDE_SQL, "classify": CLASSIFY_SQL, "cluster": CLUSTER_SQL,
               "customers": CUSTOMERS_SQL, "pred": PRED_SQL}
FIXTURE_TABLES = {"wide": ("lineitem",), "classify": ("orders", "customer", "nation"),
                  "cluster": ("customer", "nation", "orders"), "customers": ("customer", "orders"),
                  "pred": ("lineitem",)}


_TABLE_REF = re.compile(r"\b(FROM|JOIN)\s+(" + "|".join(TABLES) + r")\b")


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The fixture SQL with its tables bound as DataFrames (no session-wide temp views)."""
    text = _TABLE_REF.sub(lambda m: f"{m.group(1)} {{{m.group(2)}}}", FIXTURE_SQL[name])
    frames = {t: load_table(spark, sf_dir, t) for t in FIXTURE_TABLES[name]}
    return spark.sql(text, **frames)


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "wide")


def classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "classify")


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "cluster")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "customers")


def pred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "pred")


def with_fixture(name: str, body: str) -> str:
    """Oracle text: the fixture as the first CTE, then ``body``."""
    return f"WITH {name} AS (\n{FIXTURE_SQL[name]}\n)\n{body}"
