"""Registered queries for sources, cleaning, joins and statistics (A, B, C, D), with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from flawscope.functions.columns import clip, q
from flawscope.operators import clean as B
from flawscope.operators import combine as C
from flawscope.operators import stats as D
from flawscope.plans.registry import query, r6, sql_r6
from flawscope.session import scratch_dir
from flawscope.sources import fixtures as X
from flawscope.sources.tables import (TableSpec, load_table, read_csv, select_roles,
                                      table_shape, write_csv)
from flawscope.plans.flows import CLASSIFY_SPEC

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]
W = X.WIDE_FEATURES
CLASSIFY_COLS = ["priority", "segment", "status", "nation", "age", "hours", "gain", "loss", "high_value"]
CLASSIFY_TYPES = {"priority": "string", "segment": "string", "status": "string",
                  "nation": "string", "age": "int", "hours": "int", "gain": "double",
                  "loss": "double", "high_value": "string"}


def _csv(sql_cols: str) -> str:
    return ", ".join(sql_cols)


# ------------------------------------------------------------------------------------ A

@query("read_csv_dropmalformed", sql="""
SELECT o_orderkey, CAST(o_orderkey % 100 AS INTEGER) AS age, o_orderstatus AS status
FROM orders WHERE o_orderkey % 17 <> 0""")
def read_csv_dropmalformed(spark, sf):
    o = load_table(spark, sf, "orders")
    text = F.when(F.col("o_orderkey") % 17 == 0, F.lit(" ?")).otherwise(
        (F.col("o_orderkey") % 100).cast("string"))
    path = write_csv(o.select("o_orderkey", text.alias("age"), F.col("o_orderstatus").alias("status")),
                     scratch_dir(spark, "csv"), sep=",")
    spec = TableSpec("orders_csv", ddl="o_orderkey BIGINT, age INT, status STRING")
    return read_csv(spark, path, spec)


@query("read_csv_inferred", sql="""
SELECT CAST(l_orderkey AS INTEGER) AS l_orderkey, l_quantity, l_returnflag FROM lineitem""")
def read_csv_inferred(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    path = write_csv(li, scratch_dir(spark, "csv"), sep=",")
    return read_csv(spark, path, None, sep=",")


@query("csv_roundtrip", sql=X.with_fixture("wide", "SELECT * FROM wide"))
def csv_roundtrip(spark, sf):
    w = X.wide(spark, sf)
    path = write_csv(w, scratch_dir(spark, "csv"), sep=";", compression="gzip")
    ddl = "id BIGINT, " + ", ".join(f"{c} DOUBLE" for c in W) + ", response INT"
    return read_csv(spark, path, TableSpec("wide_csv", ddl=ddl, delimiter=";"), min_partitions=8)


@query("select_roles", sql=X.with_fixture(
    "classify", "SELECT age, priority, segment, status, nation, hours, gain, loss, high_value FROM classify"))
def select_roles_q(spark, sf):
    return select_roles(X.classify(spark, sf), CLASSIFY_SPEC)


@query("table_shape", sql=f"""
SELECT count(*) AS n_rows, CAST(11 AS INTEGER) AS n_cols, '{",".join(LINEITEM_COLS)}' AS column_names
FROM lineitem""")
def table_shape_q(spark, sf):
    return table_shape(load_table(spark, sf, "lineitem"))


# ------------------------------------------------------------------------------------ B

@query("drop_columns", sql="SELECT " + _csv(c for c in LINEITEM_COLS
                                           if c not in ("l_shipdate", "l_linestatus")) + " FROM lineitem")
def drop_columns_q(spark, sf):
    return B.drop_columns(load_table(spark, sf, "lineitem"), "l_shipdate", "l_linestatus", "no_such")


@query("keep_columns", sql="SELECT l_orderkey, l_quantity FROM lineitem")
def keep_columns_q(spark, sf):
    return B.keep_columns(load_table(spark, sf, "lineitem"), ["l_quantity", "l_orderkey", "no_such"])


@query("rename_column", sql="""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total_price, o_orderdate, o_orderpriority
FROM orders""")
def rename_column_q(spark, sf):
    return B.rename_column(load_table(spark, sf, "orders"), "o_totalprice", "total_price")


@query("apply_over_columns", sql="SELECT " + ", ".join(
    f"coalesce(CAST({c} AS VARCHAR), 'none') AS {c}" for c in LINEITEM_COLS if c != "l_shipdate")
    + ", coalesce(strftime(l_shipdate, '%Y-%m-%d %H:%M:%S'), 'none') AS l_shipdate FROM lineitem")
def apply_over_columns_q(spark, sf):
    """Every column as text (null as ``none``)."""
    return B.apply_over_columns(load_table(spark, sf, "lineitem"),
                                lambda c: F.coalesce(c.cast("string"), F.lit("none")))


def _with_constant_columns(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select(
        *li.columns,
        F.lit(1).alias("const_one"),
        F.lit(None).cast("double").alias("all_null"),
        F.when(F.col("l_linenumber") == 1, F.lit(7.0)).alias("const_with_nulls"),
        F.when(F.col("l_linenumber") == 1, F.lit(1.0)).when(F.col("l_linenumber") == 2, F.lit(2.0))
         .alias("two_with_nulls"))


_DROP_CONST_SQL = ("SELECT " + _csv(LINEITEM_COLS) + ", CAST(CASE WHEN l_linenumber = 1 THEN 1.0 "
                   "WHEN l_linenumber = 2 THEN 2.0 END AS DOUBLE) AS two_with_nulls FROM lineitem")


@query("drop_constant_columns", sql=_DROP_CONST_SQL)
def drop_constant_columns_q(spark, sf):
    return B.drop_constant_columns(_with_constant_columns(spark, sf))


@query("drop_constant_columns_approx", sql=_DROP_CONST_SQL)
def drop_constant_columns_approx_q(spark, sf):
    return B.drop_constant_columns(_with_constant_columns(spark, sf), approx=True)


@query("drop_null_rows", sql=X.with_fixture(
    "wide", "SELECT * FROM wide WHERE " + " AND ".join(f"{c} IS NOT NULL" for c in W)))
def drop_null_rows_q(spark, sf):
    return B.drop_null_rows(X.wide(spark, sf))


@query("remove_rows_with_value", sql=X.with_fixture(
    "classify", "SELECT DISTINCT * FROM classify WHERE " + " AND ".join(
        (f"{c} <> ' ?'" if CLASSIFY_TYPES[c] == "string" else f"CAST({c} AS VARCHAR) <> ' ?'")
        for c in CLASSIFY_COLS)))
def remove_rows_with_value_q(spark, sf):
    return B.remove_rows_with_value(X.classify(spark, sf), " ?")


def _null_sentinels_sql(c):
    if CLASSIFY_TYPES[c] != "string":
        return c
    return f"nullif(nullif(trim({c}), '?'), '') AS {c}"


@query("values_to_null", sql=X.with_fixture(
    "classify", "SELECT " + ", ".join(_null_sentinels_sql(c) for c in CLASSIFY_COLS) + " FROM classify"))
def values_to_null_q(spark, sf):
    out = B.trim_values(X.classify(spark, sf))
    return B.values_to_null(B.values_to_null(out, "?"), "")


@query("trim_values", sql=X.with_fixture(
    "classify", "SELECT trim(priority) AS orderpriority, trim(segment) AS segment, trim(status) AS status, "
    "trim(nation) AS nation, age, hours, gain, loss, trim(high_value) AS high_value FROM classify"))
def trim_values_q(spark, sf):
    c = X.classify(spark, sf).withColumnRenamed("priority", " order priority ")
    return B.trim_values(c)


@query("binary_conversion", sql=X.with_fixture(
    "wide", "SELECT id, " + ", ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END AS {c}" for c in W)
    + ", response FROM wide"))
def binary_conversion_q(spark, sf):
    return B.binary_conversion(X.wide(spark, sf), exclude=["id", "response"])


@query("impute_mean", sql=X.with_fixture(
    "wide", "SELECT id, " + ", ".join(sql_r6(f"coalesce({c}, avg({c}) OVER ())") + f" AS {c}" for c in W)
    + ", response FROM wide"))
def impute_mean_q(spark, sf):
    out, _ = B.impute(X.wide(spark, sf), "mean", exclude=["id", "response"])
    return out.select("id", *[r6(F.col(c)).alias(c) for c in W], "response")


@query("impute_median", sql=X.with_fixture(
    "wide", "SELECT id, " + ", ".join(f"coalesce({c}, quantile_disc({c}, 0.5) OVER ()) AS {c}" for c in W)
    + ", response FROM wide"))
def impute_median_q(spark, sf):
    out, _ = B.impute_exact_median(X.wide(spark, sf), exclude=["id", "response"])
    return out


@query("add_random_col", sql=X.with_fixture(
    "wide", "SELECT count(*) AS n_rows, count(*) AS n_flags, true AS both_seen, true AS balanced FROM wide"))
def add_random_col_q(spark, sf):
    """The random column over all rows: 0 or 1 everywhere, both seen, within 5 deviations of one half."""
    out = B.add_random_col(X.wide(spark, sf), "random", seed=42)
    n, ones = F.count(F.lit(1)), F.sum("random")
    return out.agg(n.alias("n_rows"), F.count_if(F.col("random").isin(0, 1)).alias("n_flags"),
                   ((F.min("random") == 0) & (F.max("random") == 1)).alias("both_seen"),
                   (F.abs(ones - n / 2) <= 2.5 * F.sqrt(n)).alias("balanced"))


@query("filter_label", sql=X.with_fixture("wide", "SELECT * FROM wide WHERE response = 1"))
def filter_label_q(spark, sf):
    return B.filter_label(X.wide(spark, sf), "response", 1)


@query("split_by_value", sql=X.with_fixture(
    "wide", "SELECT s7_tax AS value, count(*) AS n_rows, CAST(sum(id) AS BIGINT) AS sum_id "
    "FROM wide GROUP BY s7_tax"))
def split_by_value_q(spark, sf):
    w = X.wide(spark, sf)
    parts = [sub.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("id").alias("sum_id"))
             .select(F.lit(v).cast("double").alias("value"), "n_rows", "sum_id")
             for v, sub in B.split_by_value(w, "s7_tax")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("clip", sql="""
SELECT l_orderkey, l_linenumber, CAST(greatest(10.0, least(40.0, l_quantity)) AS DOUBLE) AS qty_clipped FROM lineitem""")
def clip_q(spark, sf):
    li = load_table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", clip(F.col("l_quantity"), 10.0, 40.0).alias("qty_clipped"))


@query("row_to_array", sql=X.with_fixture(
    "wide", "SELECT id, list_filter([" + ", ".join(W) + "], lambda x: x IS NOT NULL) AS values FROM wide"))
def row_to_array_q(spark, sf):
    return B.row_to_array(X.wide(spark, sf), W, "values", keep=["id"])


# ------------------------------------------------------------------------------------ C

_MEMBERS_SQL = "SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F'"


@query("join_cluster_members", sql=X.with_fixture(
    "wide", f"SELECT wide.* FROM wide JOIN ({_MEMBERS_SQL}) m ON wide.id = m.id"))
def join_cluster_members_q(spark, sf):
    members = load_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("id"))
    return C.join_members(X.wide(spark, sf), members, "id")


@query("semi_join_cluster_members", sql=X.with_fixture(
    "wide", f"SELECT * FROM wide WHERE id IN ({_MEMBERS_SQL})"))
def semi_join_cluster_members_q(spark, sf):
    members = load_table(spark, sf, "orders").where(F.col("o_orderstatus") == "F") \
        .select(F.col("o_orderkey").alias("id"))
    return C.join_members(X.wide(spark, sf), members, "id", semi=True)


@query("add_row_index", sql="""
SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS index FROM orders""")
def add_row_index_q(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return C.add_row_index(o, ["o_orderkey"], "index")


@query("positional_merge", sql="""
WITH one AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders),
     two AS (SELECT o_orderkey AS k2, o_custkey, o_orderpriority, o_totalprice AS price2,
                    row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders)
SELECT k2, o_custkey, o_orderpriority, price2, o_orderkey, o_totalprice FROM two JOIN one USING (rn)""")
def positional_merge_q(spark, sf):
    o = load_table(spark, sf, "orders")
    one = o.select("o_orderkey", "o_totalprice")
    two = o.select(F.col("o_orderkey").alias("k2"), "o_custkey", "o_orderpriority",
                   F.col("o_totalprice").alias("price2"))
    return C.positional_merge(one, two, ["o_orderkey"], [F.col("price2").desc(), F.col("k2")])


# ------------------------------------------------------------------------------------ D

@query("count_nulls", sql=X.with_fixture(
    "wide", "SELECT " + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS {c}"
                                  for c in ["id", *W, "response"]) + " FROM wide"))
def count_nulls_q(spark, sf):
    return D.count_nulls(X.wide(spark, sf), nan_as_null=True)


@query("distinct_counts", sql="SELECT " + ", ".join(f"count(DISTINCT {c}) AS {c}" for c in LINEITEM_COLS)
       + " FROM lineitem")
def distinct_counts_q(spark, sf):
    return D.distinct_counts(load_table(spark, sf, "lineitem"))


@query("approx_distinct_counts", sql="SELECT " + ", ".join(f"true AS {c}" for c in LINEITEM_COLS))
def approx_distinct_counts_q(spark, sf):
    """Is each estimate within three deviations (rsd 0.05) of the exact count of its column?"""
    li = load_table(spark, sf, "lineitem")
    near = D.approx_distinct_counts(li).crossJoin(  # one row each
        D.distinct_counts(li).toDF(*[f"n_{c}" for c in LINEITEM_COLS]))
    return near.select(*[(F.abs(F.col(c) - F.col(f"n_{c}")) <= F.greatest(0.15 * F.col(f"n_{c}"), F.lit(1))).alias(c)
                         for c in LINEITEM_COLS])


@query("max_distinct_values", sql=X.with_fixture(
    "classify", "SELECT greatest(" + ", ".join(f"count(DISTINCT {c})" for c in CLASSIFY_COLS)
    + ") AS max_distinct FROM classify"))
def max_distinct_values_q(spark, sf):
    return D.max_distinct_values(X.classify(spark, sf))


@query("distinct_values_count", sql="SELECT l_returnflag, count(*) AS count FROM lineitem GROUP BY l_returnflag")
def distinct_values_count_q(spark, sf):
    return D.distinct_values_count(load_table(spark, sf, "lineitem"), "l_returnflag")


@query("distinct_values", sql="SELECT DISTINCT l_linestatus FROM lineitem")
def distinct_values_q(spark, sf):
    return D.distinct_values(load_table(spark, sf, "lineitem"), "l_linestatus")


@query("column_ranges", sql=X.with_fixture(
    "wide", "SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in W) + " FROM wide"))
def column_ranges_q(spark, sf):
    return D.column_ranges(X.wide(spark, sf), W)


@query("population_stats", sql="""
SELECT l_returnflag, round(avg(l_quantity), 6) + 0.0 AS mean, round(var_pop(l_quantity), 6) + 0.0 AS variance,
       round(stddev_pop(l_quantity), 6) + 0.0 AS std_dev
FROM lineitem GROUP BY l_returnflag""")
def population_stats_q(spark, sf):
    out = D.population_stats(load_table(spark, sf, "lineitem"), "l_quantity", by=["l_returnflag"])
    return out.select("l_returnflag", *[r6(F.col(c)).alias(c) for c in ("mean", "variance", "std_dev")])


@query("column_to_array", sql="""
SELECT l_orderkey, list_sort(list(l_quantity)) AS values FROM lineitem GROUP BY l_orderkey""")
def column_to_array_q(spark, sf):
    return D.column_to_array(load_table(spark, sf, "lineitem"), "l_quantity", ["l_orderkey"])


@query("exact_quantiles", sql="""
SELECT quantile_disc(l_extendedprice, 0.1) AS p10, quantile_disc(l_extendedprice, 0.5) AS p50,
       quantile_disc(l_extendedprice, 0.9) AS p90, quantile_disc(l_quantity, 0.5) AS q50
FROM lineitem""")
def exact_quantiles_q(spark, sf):
    li = load_table(spark, sf, "lineitem")
    got = D.exact_quantiles(li, ["l_extendedprice", "l_quantity"], [0.1, 0.5, 0.9])
    p = got["l_extendedprice"]
    row = [(p[0], p[1], p[2], got["l_quantity"][1])]
    return spark.createDataFrame(row, "p10 double, p50 double, p90 double, q50 double")


@query("exact_quantile_bigint", sql="""
WITH b AS (SELECT l_orderkey + 9007199254740992 AS big FROM lineitem)
SELECT quantile_disc(big, 0.25) AS p25, quantile_disc(big, 0.5) AS p50, quantile_disc(big, 0.75) AS p75 FROM b""")
def exact_quantile_bigint_q(spark, sf):
    """Integers beyond 2^53 keep their last digit."""
    big = load_table(spark, sf, "lineitem").select((F.col("l_orderkey") + F.lit(9007199254740992)).alias("big"))
    got = D.exact_quantiles(big, ["big"], [0.25, 0.5, 0.75])["big"]
    return spark.createDataFrame([tuple(got)], "p25 bigint, p50 bigint, p75 bigint")
