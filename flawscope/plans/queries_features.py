"""Registered queries for sampling and features (E, F), with oracles."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from flawscope.operators import features as FE
from flawscope.operators import sampling as E
from flawscope.plans.flows import AGE_SPLITS, HOURS_SPLITS
from flawscope.plans.registry import query, r6, sql_r6
from flawscope.sources import fixtures as X
from flawscope.sources.tables import load_table

W = X.WIDE_FEATURES
MOD, MULT, ADD = E.BUCKET_MOD, E.BUCKET_MULT, E.BUCKET_ADD


def _hash_sql(key: str) -> str:
    return f"((({key} % {MOD}) * {MULT} + {ADD}) % {MOD})"


# ------------------------------------------------------------------------------------ E

@query("drop_duplicates", sql=X.with_fixture("classify", "SELECT DISTINCT * FROM classify"))
def drop_duplicates_q(spark, sf):
    c = X.classify(spark, sf)
    return E.drop_duplicates(c.unionAll(c))


_ISECT = "SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem WHERE "


@query("intersect_rows", sql=f"{_ISECT} l_discount > 0.05 INTERSECT {_ISECT} l_quantity > 25")
def intersect_rows_q(spark, sf):
    li = load_table(spark, sf, "lineitem")
    cols = ["l_returnflag", "l_linestatus", "l_quantity"]
    return E.intersect_rows(li.where("l_discount > 0.05").select(*cols),
                            li.where("l_quantity > 25").select(*cols))


@query("union_by_name", sql=X.with_fixture("wide", "SELECT * FROM wide"))
def union_by_name_q(spark, sf):
    w = X.wide(spark, sf)
    failures = w.where("response = 1")
    goods = w.where("response = 0").select(*reversed(w.columns))
    return E.union_by_name(goods, failures)


@query("take_subset", sql="""
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, true AS within FROM orders""")
def take_subset_q(spark, sf):
    """The random subset and its rest add up to the table; its size is within 5 deviations."""
    o = load_table(spark, sf, "orders")
    part = E.take_subset(o, 0.5, seed=42).select("o_orderkey", F.lit(1).alias("taken"))
    all_ = o.select("o_orderkey").join(part, "o_orderkey", "left")
    n = F.count(F.lit(1))
    return all_.agg(n.alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"),
                    (F.abs(F.count("taken") - n / 2) <= 2.5 * F.sqrt(n)).alias("within"))


@query("take_subset_hash", sql=f"SELECT * FROM orders WHERE {_hash_sql('o_orderkey')} < 0.5 * {MOD}")
def take_subset_hash_q(spark, sf):
    return E.take_subset_by_key(load_table(spark, sf, "orders"), "o_orderkey", 0.5)


@query("take_subset_hash_small", sql=f"SELECT * FROM lineitem WHERE {_hash_sql('l_orderkey')} < 0.003 * {MOD}")
def take_subset_hash_small_q(spark, sf):
    return E.take_subset_by_key(load_table(spark, sf, "lineitem"), "l_orderkey", 0.003)


@query("train_test_split", sql="""
SELECT count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_keys, true AS within FROM orders""")
def train_test_split_q(spark, sf):
    """Both parts of the random split: together the table, no row twice, 80/20 within 5 deviations."""
    train, test = E.train_test_split(load_table(spark, sf, "orders"), 0.8, seed=42)
    both = train.select("o_orderkey", F.lit(1).alias("t")).unionAll(test.select("o_orderkey", F.lit(0).alias("t")))
    n = F.count(F.lit(1))
    return both.agg(n.alias("n_rows"), F.count_distinct("o_orderkey").alias("n_keys"),
                    (F.abs(F.sum("t") - 0.8 * n) <= 2 * F.sqrt(n)).alias("within"))


@query("train_test_split_key", sql=f"""
SELECT o_orderkey, o_totalprice,
       CASE WHEN {_hash_sql('o_orderkey')} < 0.8 * {MOD} THEN 'train' ELSE 'test' END AS split FROM orders""")
def train_test_split_key_q(spark, sf):
    o = load_table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return E.split_label_by_key(o, "o_orderkey", 0.8)


@query("undersample_majority", sql=X.with_fixture("wide", f"""
, mino AS (SELECT * FROM wide WHERE response = 0),
  maj AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql('id')}, id) AS rn FROM wide WHERE response = 1)
SELECT * FROM mino
UNION ALL
SELECT * EXCLUDE (rn) FROM maj WHERE rn <= (SELECT count(*) FROM mino)""".replace("\n, mino", ", mino", 1)))
def undersample_majority_q(spark, sf):
    w = X.wide(spark, sf)
    return E.undersample_majority(w, "response", 0, 1, [E.key_hash(F.col("id")), F.col("id")], 1.0)


@query("random_table", sql="""
SELECT count(*) AS n_rows, true AS inside, true AS centred FROM lineitem""")
def random_table_q(spark, sf):
    """A random row for every row of the table: values in [0, 100), means within 5 deviations of 50."""
    r = E.random_like(load_table(spark, sf, "lineitem"), 4, 0.0, 100.0, seed=42)
    cols = [F.col(f"`{c}`") for c in r.columns]
    inside, centred = F.lit(True), F.lit(True)
    for c in cols:
        inside = inside & (F.min(c) >= 0) & (F.max(c) < 100)
        centred = centred & (F.abs(F.avg(c) - 50) <= 5 * 28.9 / F.sqrt(F.count(F.lit(1))))
    return r.agg(F.count(F.lit(1)).alias("n_rows"), inside.alias("inside"), centred.alias("centred"))


# ------------------------------------------------------------------------------------ F

def _bin_case(col: str, splits) -> str:
    parts = []
    for i in range(len(splits) - 1):
        lo, hi = splits[i], splits[i + 1]
        upper = "<=" if i == len(splits) - 2 else "<"
        parts.append(f"WHEN {col} >= {lo} AND {col} {upper} {hi} THEN {i}")
    return f"CAST(CASE {' '.join(parts)} END AS DOUBLE) AS {col}"


AGE, HOURS = AGE_SPLITS, HOURS_SPLITS


@query("binning", sql=X.with_fixture(
    "classify", "SELECT priority, segment, status, nation, gain, loss, high_value, "
    + _bin_case("age", AGE) + ", " + _bin_case("hours", HOURS) + " FROM classify"))
def binning_q(spark, sf):
    out, _ = FE.binning(X.classify(spark, sf), "age", AGE)
    out, _ = FE.binning(out, "hours", HOURS)
    return out


def _qbin_sql(table: str, col: str, n: int, keep: str, prefix: str = "") -> str:
    probs = ", ".join(str(i / n) for i in range(1, n))
    return (f"{prefix}SELECT {keep}, CAST(len(list_filter(sp, lambda v: v <= {col})) AS DOUBLE) AS {col} "
            f"FROM {table}, (SELECT list_distinct(quantile_disc({col}, [{probs}])) AS sp FROM {table}) s")


@query("quantile_bins", sql=_qbin_sql("lineitem", "l_extendedprice", 5, "l_orderkey, l_linenumber"))
def quantile_bins_q(spark, sf):
    li = load_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out, _ = FE.quantile_bins(li, "l_extendedprice", 5, exact=True)
    return out


@query("quantile_bins_collapsed", sql=X.with_fixture(
    "classify", _qbin_sql("classify", "gain", 10, "priority, segment, status, nation, age, hours, loss, high_value")))
def quantile_bins_collapsed_q(spark, sf):
    out, _ = FE.quantile_bins(X.classify(spark, sf), "gain", 10, exact=True)
    return out


_VEC4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("assemble", sql="SELECT l_orderkey, l_linenumber, [" + ", ".join(_VEC4) + "] AS features FROM lineitem")
def assemble_q(spark, sf):
    li = load_table(spark, sf, "lineitem")
    v = FE.assemble(li, "features", _VEC4)
    return v.select("l_orderkey", "l_linenumber", vector_to_array("features").alias("features"))


@query("standardize", sql="SELECT l_orderkey, l_linenumber, " + ", ".join(
    sql_r6(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()") + f" AS f{i}" for i, c in enumerate(_VEC4))
    + " FROM lineitem")
def standardize_q(spark, sf):
    li = load_table(spark, sf, "lineitem")
    v, _ = FE.standardize(FE.assemble(li, "features", _VEC4).select("l_orderkey", "l_linenumber", "features"))
    out = FE.vector_to_columns(v, "features", size=4)
    return out.select("l_orderkey", "l_linenumber", *[r6(F.col(f"f{i}")).alias(f"f{i}") for i in range(4)])


@query("vector_to_columns", sql="SELECT vec_id, label, " + ", ".join(
    f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(64)) + " FROM embeddings")
def vector_to_columns_q(spark, sf):
    e = load_table(spark, sf, "embeddings")
    v = e.select("vec_id", "label", array_to_vector("embedding").alias("vec"))
    return FE.vector_to_columns(v, "vec", size=64)


def loadings(d: int = 64, n: int = 2) -> list[list[float]]:
    """A fixed d x n loading matrix built by rule: w[i][j] = ((7i + 3j) mod 11 - 5) / 10."""
    return [[((7 * i + 3 * j) % 11 - 5) / 10 for j in range(n)] for i in range(d)]


def _proj_sql(j: int) -> str:
    w = loadings()
    terms = " + ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) * CAST({w[i][j]} AS DOUBLE)" for i in range(64))
    return sql_r6(terms) + f" AS c{j}"


@query("project_fixed_loadings", sql="SELECT vec_id, " + _proj_sql(0) + ", " + _proj_sql(1) + " FROM embeddings")
def project_fixed_loadings_q(spark, sf):
    e = load_table(spark, sf, "embeddings")
    out = FE.project_fixed(e, "embedding", loadings(), keep=["vec_id"])
    return out.select("vec_id", r6(F.col("c0")).alias("c0"), r6(F.col("c1")).alias("c1"))


_SHARES_SQL = X.with_fixture("wide", ", v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, var_samp({c}) AS var FROM wide" for c in W) + """),
s AS (SELECT name, var / sum(var) OVER () AS share FROM v),
r AS (SELECT name, share, row_number() OVER (ORDER BY share DESC, name) - 1 AS component FROM s),
c AS (SELECT component, name, share, sum(share) OVER (ORDER BY component ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM r)
SELECT component, name, round(share, 6) + 0.0 AS share, round(cum, 6) + 0.0 AS cum_share,
       cum <= 0.95 AS keep_at_most, cum - share < 0.95 AS keep_at_least FROM c""")


@query("explained_prefix", sql=_SHARES_SQL)
def explained_prefix_q(spark, sf):
    w = X.wide(spark, sf)
    v = w.agg(*[F.var_samp(c).alias(c) for c in W])
    long = v.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("var"))
                                        for c in W])).alias("s")).select("s.*")
    # 28 rows (one per feature): a global window over them is bounded by the column count
    share = long.select("name", (F.col("var") / F.sum("var").over(Window.partitionBy())).alias("share"))
    ranked = share.withColumn("component", (F.row_number().over(
        Window.orderBy(F.col("share").desc(), F.col("name"))) - 1).cast("long"))
    out = FE.explained_prefix(ranked, "component", "share", 0.95).join(ranked.select("component", "name"),
                                                                       "component")
    return out.select("component", "name", r6(F.col("share")).alias("share"),
                      r6(F.col("cum_share")).alias("cum_share"), "keep_at_most", "keep_at_least")


_IDX_COLS = ["priority", "segment", "status", "nation", "age"]


def _index_sql() -> str:
    ctes, joins, outs = [], [], []
    for i, c in enumerate(_IDX_COLS):
        key = f"CAST({c} AS VARCHAR)"
        ctes.append(f"i{i} AS (SELECT {key} AS v, row_number() OVER (ORDER BY count(*) DESC, {key}) - 1 AS ix "
                    f"FROM classify GROUP BY {key})")
        joins.append(f"JOIN i{i} ON CAST(c.{c} AS VARCHAR) = i{i}.v")
        outs.append(f'CAST(i{i}.ix AS DOUBLE) AS "indexed-{c}"')
    return (X.with_fixture("classify", ", " + ", ".join(ctes)).replace("\n, ", ", ", 1)
            + "\nSELECT c.*, " + ", ".join(outs) + " FROM classify c " + " ".join(joins))


@query("index_features", sql=_index_sql())
def index_features_q(spark, sf):
    out, _ = FE.index_features(X.classify(spark, sf), _IDX_COLS)
    return out


_LABEL_IDX = X.with_fixture("classify", """, li AS (SELECT high_value AS v,
    row_number() OVER (ORDER BY count(*) DESC, high_value) - 1 AS ix FROM classify GROUP BY high_value)
""".replace("\n", " ", 1))


@query("index_label", sql=_LABEL_IDX + "SELECT c.*, CAST(li.ix AS DOUBLE) AS label FROM classify c JOIN li ON c.high_value = li.v")
def index_label_q(spark, sf):
    out, _ = FE.index_label(X.classify(spark, sf), "high_value", "label")
    return out


@query("index_to_label", sql=_LABEL_IDX + 'SELECT c.high_value, CAST(li.ix AS DOUBLE) AS label, '
       'li.v AS "predicted-high_value" FROM classify c JOIN li ON c.high_value = li.v')
def index_to_label_q(spark, sf):
    indexed, model = FE.index_label(X.classify(spark, sf).select("high_value"), "high_value", "label")
    return FE.index_to_label(indexed, model.labels, "label", target="high_value")
