"""Registered queries for clustering, metrics, classifiers and flows (G, H, I, J, A7-A9)."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from flawscope.functions.columns import squared_distance_arrays
from flawscope.operators import classify as H
from flawscope.operators import clustering as G
from flawscope.operators import features as FE
from flawscope.operators import metrics as M
from flawscope.operators.sampling import (BUCKET_ADD, BUCKET_MOD, BUCKET_MULT, split_by_key,
                                          train_test_split)
from flawscope.operators.tree_grid import grid_by_truncation, predictions_by_depth
from flawscope.plans import flows as J
from flawscope.plans.registry import query, r6, sql_r6
from flawscope.session import materialize, scratch_dir
from flawscope.sources import fixtures as X
from flawscope.sources.models import load_classifier, load_kmeans, save_classifier, save_kmeans
from flawscope.sources.tables import load_table

# ------------------------------------------------------------------ shared point set for G3-G5
# Points: (quantity, discount x 100, tax x 100) of every line item; groups: return flag A/N/R.
_PTS_SQL = """SELECT l_orderkey, l_linenumber,
       CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS cluster,
       l_quantity AS x1, l_discount * 100 AS x2, l_tax * 100 AS x3 FROM lineitem"""
_XS = ("x1", "x2", "x3")


def _points(spark, sf):
    li = load_table(spark, sf, "lineitem")
    code = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    pts = li.select("l_orderkey", "l_linenumber", code.alias("cluster"),
                    F.col("l_quantity").alias("x1"), (F.col("l_discount") * 100).alias("x2"),
                    (F.col("l_tax") * 100).alias("x3"))
    return FE.assemble(pts, "features", list(_XS))


def _group_centres(pts):
    """Group means rounded to 6 decimals, ordered by group (3 rows reach the driver)."""
    rows = (pts.groupBy("cluster").agg(*[F.round(F.avg(x), 6).alias(x) for x in _XS])
               .orderBy("cluster").collect())
    return [[float(r[x]) for x in _XS] for r in rows]


_CENTRES_SQL = "c AS (SELECT " + ", ".join(
    f"max(CASE WHEN cluster = {k} THEN m{x} END) AS c{k}{x}" for k in range(3) for x in _XS) + \
    " FROM (SELECT cluster, " + ", ".join(f"round(avg({x}), 6) AS m{x}" for x in _XS) + \
    " FROM p GROUP BY cluster))"


def _dist_sql(k: int) -> str:
    return "(" + " + ".join(f"pow({x} - c{k}{x}, 2)" for x in _XS) + ")"


@query("silhouette", sql=f"""
WITH p AS (SELECT row_number() OVER () AS pid, * FROM ({_PTS_SQL})),
s AS (SELECT cluster AS c, count(*) AS n, sum(x1) AS y1, sum(x2) AS y2, sum(x3) AS y3,
             sum(x1 * x1 + x2 * x2 + x3 * x3) AS psi FROM p GROUP BY cluster),
d AS (SELECT p.pid, p.cluster AS own, s.c, s.n,
             (x1 * x1 + x2 * x2 + x3 * x3) + s.psi / s.n - 2 * (x1 * s.y1 + x2 * s.y2 + x3 * s.y3) / s.n AS dd
      FROM p, s),
per AS (SELECT pid, max(CASE WHEN c = own AND n > 1 THEN dd * n / (n - 1) END) AS a,
               min(CASE WHEN c <> own THEN dd END) AS b, max(CASE WHEN c = own THEN n END) AS own_n
        FROM d GROUP BY pid)
SELECT round(avg(CASE WHEN own_n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM per""")
def silhouette_q(spark, sf):
    v = G.silhouette_value(_points(spark, sf), "features", "cluster")
    return spark.createDataFrame([(v,)], "silhouette double").select(r6(F.col("silhouette")).alias("silhouette"))


@query("inertia", sql=f"""
WITH p AS ({_PTS_SQL}), {_CENTRES_SQL}
SELECT round(sum(least({_dist_sql(0)}, {_dist_sql(1)}, {_dist_sql(2)})), 2) + 0.0 AS inertia FROM p, c""")
def inertia_q(spark, sf):
    pts = _points(spark, sf)
    out = G.inertia(pts, _group_centres(pts), "features")
    return out.select((F.round("inertia", 2) + F.lit(0.0)).alias("inertia"))


@query("nearest_center", sql=f"""
WITH p AS ({_PTS_SQL}), {_CENTRES_SQL},
d AS (SELECT l_orderkey, l_linenumber, {_dist_sql(0)} AS d0, {_dist_sql(1)} AS d1, {_dist_sql(2)} AS d2 FROM p, c)
SELECT l_orderkey, l_linenumber,
       CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS nearest,
       round(least(d0, d1, d2), 6) + 0.0 AS cost FROM d""")
def nearest_center_q(spark, sf):
    pts = _points(spark, sf)
    out = G.nearest_center(pts, _group_centres(pts), "features", keep=["l_orderkey", "l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", "nearest", r6(F.col("cost")).alias("cost"))


@query("squared_distance", sql="""
WITH e AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT label, i, round(avg(x), 6) AS m FROM e GROUP BY label, i)
SELECT vec_id, round(sum((x - m) * (x - m)), 6) + 0.0 AS sqdist FROM e JOIN c USING (label, i) GROUP BY vec_id""")
def squared_distance_q(spark, sf):
    e = load_table(spark, sf, "embeddings")
    parts = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    cent = parts.groupBy("label", "pos").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    # one centre per label (64 values each): sorted by position, then joined on the label
    arr = cent.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("s")) \
        .select("label", F.transform("s", lambda t: t["m"]).alias("centre"))
    joined = e.join(arr, "label")
    return joined.select("vec_id", r6(squared_distance_arrays(F.col("embedding"), F.col("centre"))).alias("sqdist"))


_GAP_BASE = """ev AS (SELECT 2 + user_id % 5 AS k, event_id % 30 AS b, value FROM events),
ref AS (SELECT k, b, ln(sum(value * value) + 1) AS log_w FROM ev GROUP BY k, b),
obs AS (SELECT k, ln(sum(abs(value)) + 1) AS log_w FROM ev GROUP BY k),
g AS (SELECT k, avg(r.log_w) - o.log_w AS gap, stddev_pop(r.log_w) * sqrt(1 + 1 / count(*)) AS s
      FROM ref r JOIN obs o USING (k) GROUP BY k, o.log_w)"""


def _gap_tables(spark, sf):
    ev = load_table(spark, sf, "events").select((F.col("user_id") % 5 + 2).alias("k"),
                                                (F.col("event_id") % 30).alias("b"), "value")
    ref = ev.groupBy("k", "b").agg(F.log(F.sum(F.col("value") * F.col("value")) + 1).alias("log_w"))
    obs = ev.groupBy("k").agg(F.log(F.sum(F.abs("value")) + 1).alias("log_w"))
    return G.gap_table(obs, ref)


@query("gap_statistic", sql=f"WITH {_GAP_BASE}\nSELECT k, round(gap, 6) + 0.0 AS gap, round(s, 6) + 0.0 AS s FROM g")
def gap_statistic_q(spark, sf):
    g = _gap_tables(spark, sf)
    return g.select("k", r6(F.col("gap")).alias("gap"), r6(F.col("s")).alias("s"))


@query("choose_k", sql=f"""WITH {_GAP_BASE},
f AS (SELECT k, coalesce(gap > lead(gap) OVER (ORDER BY k) - lead(s) OVER (ORDER BY k), false) AS stop FROM g)
SELECT coalesce(min(CASE WHEN stop THEN k END), max(k)) AS chosen_k FROM f""")
def choose_k_q(spark, sf):
    return G.choose_k(_gap_tables(spark, sf))


def _arrest_like(spark, sf):
    """One row per customer, 4 numeric columns, assembled and standardised."""
    prepared, _ = J.prepare_cluster_table(X.customers(spark, sf), "id")
    return prepared


@query("kmeans_fit_predict", sql=X.with_fixture("customers", "SELECT id, true AS is_nearest FROM customers"))
def kmeans_fit_predict_q(spark, sf):
    """Every row's group is the one with the nearest centre."""
    df = _arrest_like(spark, sf)
    model = G.kmeans_fit(df, 2, seed=42)
    near = G.nearest_center(G.assign(model, df), G.centers_of(model), keep=["id", "prediction"])
    return near.select("id", (F.col("nearest") == F.col("prediction")).alias("is_nearest"))


@query("cluster_centers", sql=X.with_fixture(
    "customers", "SELECT CAST(2 AS BIGINT) AS n_centers, count(*) AS n_rows, true AS are_means FROM customers"))
def cluster_centers_q(spark, sf):
    """At convergence each centre is the mean of its rows; the groups add up to the table."""
    df = _arrest_like(spark, sf)
    model = G.kmeans_fit(df, 2, seed=42, max_iter=200, tol=1e-9)
    x = FE.vector_to_columns(G.assign(model, df), "features", size=4)
    means = x.groupBy("prediction").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"f{i}").alias(f"f{i}") for i in range(4)])
    both = G.cluster_centers(model, spark).join(means, F.col("cluster") == F.col("prediction"))
    near = F.lit(True)
    for i in range(4):
        near = near & (F.abs(F.col("center").getItem(i) - F.col(f"f{i}")) < 1e-6)
    return both.agg(F.count(F.lit(1)).alias("n_centers"), F.sum("n").alias("n_rows"), F.bool_and(near).alias("are_means"))


@query("reference_uniform", sql=X.with_fixture(
    "customers", "SELECT count(*) AS n_rows, true AS inside, true AS spread FROM customers"))
def reference_uniform_q(spark, sf):
    """A draw for every row, inside the box of the features, and over most of each side."""
    df = _arrest_like(spark, sf)
    ranges = G.feature_ranges(df)
    ref = G.reference_uniform(df, ranges, seed=1).select(vector_to_array("features").alias("x"))
    inside, spread = F.lit(True), F.lit(True)
    for i, (a, b) in enumerate(ranges):
        v = F.col("x").getItem(i)
        inside = inside & (F.min(v) >= a) & (F.max(v) <= b)
        spread = spread & (F.max(v) - F.min(v) >= 0.8 * (b - a))
    return ref.agg(F.count(F.lit(1)).alias("n_rows"), inside.alias("inside"), spread.alias("spread"))


@query("model_roundtrip_kmeans", sql=X.with_fixture(
    "customers", "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM customers"))
def model_roundtrip_kmeans_q(spark, sf):
    """Groups before and after storing the model, over all rows."""
    df = _arrest_like(spark, sf)
    model = G.kmeans_fit(df, 2, seed=42)
    loaded = load_kmeans(save_kmeans(model, scratch_dir(spark, "kmeans")))
    both = loaded.setPredictionCol("again").transform(model.transform(df))
    return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("prediction") != F.col("again")).alias("n_different"))


@query("flow_cluster_prepare", sql=X.with_fixture("customers", "SELECT id, " + ", ".join(
    sql_r6(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER ()") + f" AS f{i}"
    for i, c in enumerate(["balance", "orders", "spend", "max_order"])) + " FROM customers"))
def flow_cluster_prepare_q(spark, sf):
    out = FE.vector_to_columns(_arrest_like(spark, sf), "features", size=4)
    return out.select("id", *[r6(F.col(f"f{i}")).alias(f"f{i}") for i in range(4)])


@query("flow_cluster", sql=X.with_fixture("customers", """
SELECT count(*) AS n_rows, true AS k_in_range, true AS within_total, true AS silhouette_in_range FROM customers"""))
def flow_cluster_q(spark, sf):
    """The whole clustering flow: every row has a group, 2 <= k <= 10, the inertia is at most the
    total sum of squares (4 standardised columns), the silhouette lies in [-1, 1]."""
    assigned, summary, model, _ = J.cluster_flow(X.customers(spark, sf), "id", max_k=10, num_random=30)
    s, k = summary.first(), len(G.centers_of(model))
    return assigned.agg(F.count_if(F.col("prediction").between(0, k - 1)).alias("n_rows")).select(
        "n_rows", F.lit(2 <= s.k <= 10 and s.k == k).alias("k_in_range"),
        (F.lit(s.inertia) <= 4 * (F.col("n_rows") - 1) + 1e-6).alias("within_total"),
        F.lit(s.silhouette is not None and -1 <= s.silhouette <= 1).alias("silhouette_in_range"))


# ------------------------------------------------------------------------------------ I

_PRED = X.with_fixture("pred", "")


def _conf_sql(by: str = "") -> str:
    sel = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return (f"SELECT {sel}CAST(count_if(label = 0 AND prediction = 0) AS BIGINT) AS tn, "
            "CAST(count_if(label = 0 AND prediction = 1) AS BIGINT) AS fp, "
            "CAST(count_if(label = 1 AND prediction = 0) AS BIGINT) AS fn, "
            f"CAST(count_if(label = 1 AND prediction = 1) AS BIGINT) AS tp FROM pred{grp}")


_SCORES = """CAST(tp AS DOUBLE) AS tp, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tn AS DOUBLE) AS tn"""
_PREC = "CASE WHEN tp + fp = 0 THEN tp ELSE tp / (tp + fp) END"
_REC = "CASE WHEN tp + fn = 0 THEN tp ELSE tp / (tp + fn) END"
_MCC = ("CASE WHEN sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) = 0 THEN tp * tn - fp * fn "
        "ELSE (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) END")


@query("confusion_matrix", sql=_PRED + _conf_sql())
def confusion_matrix_q(spark, sf):
    return M.confusion_counts(X.pred(spark, sf))


@query("precision", sql=_PRED + f", cm AS ({_conf_sql()}), d AS (SELECT {_SCORES} FROM cm) "
       f"SELECT {sql_r6(_PREC)} AS precision FROM d")
def precision_q(spark, sf):
    return M.precision(X.pred(spark, sf)).select(r6(F.col("precision")).alias("precision"))


@query("recall", sql=_PRED + f", cm AS ({_conf_sql()}), d AS (SELECT {_SCORES} FROM cm) "
       f"SELECT {sql_r6(_REC)} AS recall FROM d")
def recall_q(spark, sf):
    return M.recall(X.pred(spark, sf)).select(r6(F.col("recall")).alias("recall"))


@query("mcc", sql=_PRED + f", cm AS ({_conf_sql()}), d AS (SELECT {_SCORES} FROM cm) "
       f"SELECT {sql_r6(_MCC)} AS mcc FROM d")
def mcc_q(spark, sf):
    return M.mcc(X.pred(spark, sf)).select(r6(F.col("mcc")).alias("mcc"))


@query("accuracy", sql=_PRED + "SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS accuracy FROM pred")
def accuracy_q(spark, sf):
    return M.accuracy(X.pred(spark, sf)).select(r6(F.col("accuracy")).alias("accuracy"))


def _weighted_sql(src: str, by: str = "") -> str:
    """Class-weighted F1 / precision / recall, accuracy, Hamming loss over ``src`` (label, prediction)."""
    k = f"{by}, " if by else ""
    using = f"USING ({by}, cls)" if by else "USING (cls)"
    grp = f" GROUP BY {by}" if by else ""
    return f"""bl AS (SELECT {k}label AS cls, count(*) AS nl, CAST(count_if(prediction = label) AS DOUBLE) AS tp
             FROM {src} GROUP BY {k}label),
bp AS (SELECT {k}prediction AS cls, count(*) AS np FROM {src} GROUP BY {k}prediction),
t AS (SELECT {k}CAST(nl AS DOUBLE) AS nl, tp, CAST(coalesce(np, 0) AS DOUBLE) AS np FROM bl LEFT JOIN bp {using}),
m AS (SELECT {k}nl, tp, CASE WHEN np = 0 THEN 0.0 ELSE tp / np END AS prec,
             CASE WHEN nl = 0 THEN 0.0 ELSE tp / nl END AS rec FROM t),
w AS (SELECT {k}sum(nl * CASE WHEN prec + rec = 0 THEN 0.0 ELSE 2 * prec * rec / (prec + rec) END) / sum(nl) AS f1,
             sum(prec * nl) / sum(nl) AS weighted_precision, sum(rec * nl) / sum(nl) AS weighted_recall,
             sum(tp) / sum(nl) AS accuracy, 1 - sum(tp) / sum(nl) AS hamming_loss FROM m{grp})"""


@query("f1_weighted", sql=_PRED + ", " + _weighted_sql("pred") + f"\nSELECT {sql_r6('f1')} AS f1 FROM w")
def f1_weighted_q(spark, sf):
    return M.f1_weighted(X.pred(spark, sf)).select(r6(F.col("f1")).alias("f1"))


_MC_SRC = ("mc AS (SELECT CAST(l_linenumber - 1 AS DOUBLE) AS label, CAST(l_partkey % 7 AS DOUBLE) AS prediction "
           "FROM lineitem)")
_MC_COLS = ("f1", "weighted_precision", "weighted_recall", "accuracy", "hamming_loss")


@query("multiclass_metrics", sql=f"WITH {_MC_SRC}, " + _weighted_sql("mc") + "\nSELECT "
       + ", ".join(f"{sql_r6(c)} AS {c}" for c in _MC_COLS) + " FROM w")
def multiclass_metrics_q(spark, sf):
    li = load_table(spark, sf, "lineitem")
    mc = li.select((F.col("l_linenumber") - 1).cast("double").alias("label"),
                   (F.col("l_partkey") % 7).cast("double").alias("prediction"))
    out = M.multiclass_scores(mc)
    return out.select(*[r6(F.col(c)).alias(c) for c in _MC_COLS])


def _auroc_sql(by: str = "") -> str:
    k = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""ag AS (SELECT {k}score, sum(label) AS pos, count(*) - sum(label) AS neg FROM pred GROUP BY {k}score),
cu AS (SELECT {k}pos, neg, coalesce(sum(pos) OVER ({part}ORDER BY score DESC
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ag),
au AS (SELECT {k}sum(neg * (before + pos / 2.0)) / (sum(pos) * sum(neg)) AS auroc FROM cu{grp})"""


@query("auroc", sql=_PRED + ", " + _auroc_sql() + f"\nSELECT {sql_r6('auroc')} AS auroc FROM au")
def auroc_q(spark, sf):
    return M.auroc(X.pred(spark, sf), score="score", label="label").select(r6(F.col("auroc")).alias("auroc"))


@query("auroc_continuous", sql="WITH pred AS (SELECT CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE) AS label, "
       "l_extendedprice AS score FROM lineitem), " + _auroc_sql() + f"\nSELECT {sql_r6('auroc')} AS auroc FROM au")
def auroc_continuous_q(spark, sf):
    """Nearly as many distinct scores as rows."""
    li = load_table(spark, sf, "lineitem").select(
        (F.col("l_returnflag") == "R").cast("double").alias("label"), F.col("l_extendedprice").alias("score"))
    return M.auroc(li, score="score").select(r6(F.col("auroc")).alias("auroc"))


@query("score_table_null_group", sql=_PRED.replace("l_linestatus,", "nullif(l_linestatus, 'F') AS l_linestatus,")
       + f", cm AS ({_conf_sql('l_linestatus')}), d AS (SELECT l_linestatus, {_SCORES} FROM cm), "
       + _auroc_sql("l_linestatus") + f"""
SELECT d.l_linestatus, {sql_r6(_PREC)} AS precision, {sql_r6('au.auroc')} AS auroc, {sql_r6(_MCC)} AS mcc
FROM d JOIN au ON d.l_linestatus IS NOT DISTINCT FROM au.l_linestatus""")
def score_table_null_group_q(spark, sf):
    """Groups with a null among them."""
    p = X.pred(spark, sf).withColumn("l_linestatus", F.nullif(F.col("l_linestatus"), F.lit("F")))
    out = M.score_table(p, score="score", by="l_linestatus")
    return out.select("l_linestatus", *[r6(F.col(c)).alias(c) for c in ("precision", "auroc", "mcc")])


@query("score_table", sql=_PRED + f", cm AS ({_conf_sql('l_linestatus')}), "
       f"d AS (SELECT l_linestatus, {_SCORES} FROM cm), " + _weighted_sql("pred", "l_linestatus") + ", "
       + _auroc_sql("l_linestatus") + f"""
SELECT l_linestatus, {sql_r6('w.accuracy')} AS accuracy, {sql_r6(_PREC)} AS precision, {sql_r6(_REC)} AS recall,
       {sql_r6('w.f1')} AS f1, {sql_r6('au.auroc')} AS auroc, {sql_r6(_MCC)} AS mcc
FROM d JOIN w USING (l_linestatus) JOIN au USING (l_linestatus)""")
def score_table_q(spark, sf):
    out = M.score_table(X.pred(spark, sf), score="score", by="l_linestatus")
    return out.select("l_linestatus", *[r6(F.col(c)).alias(c) for c in
                                        ("accuracy", "precision", "recall", "f1", "auroc", "mcc")])


# ------------------------------------------------------------------------------------ H / J

def _classify_prepared(spark, sf):
    return J.prepare_classify_table(X.classify(spark, sf))


_PREPARED = """
t AS (SELECT DISTINCT * FROM (
        SELECT age, hours, gain, loss, nullif(nullif(trim(priority), '?'), '') AS priority,
               nullif(nullif(trim(segment), '?'), '') AS segment, nullif(nullif(trim(status), '?'), '') AS status,
               nullif(nullif(trim(nation), '?'), '') AS nation,
               nullif(nullif(trim(high_value), '?'), '') AS high_value FROM classify)
      WHERE age IS NOT NULL AND priority IS NOT NULL AND segment IS NOT NULL AND status IS NOT NULL
        AND nation IS NOT NULL AND hours IS NOT NULL AND gain IS NOT NULL AND loss IS NOT NULL
        AND high_value IS NOT NULL)
"""
_ROWS_PER_LABEL = X.with_fixture("classify", "," + _PREPARED
                                 + "SELECT high_value, count(*) AS n_rows, count(*) AS n_consistent, "
                                   "true AS beats_majority FROM t GROUP BY 1")


def _consistent(preds, target, labels, rest=None):
    """Rows per label of all predicted rows (and of the rows ``rest`` that only trained), and how
    many have a known label index, a prediction and that prediction's label text."""
    names = F.array(*[F.lit(x) for x in labels])
    text = F.element_at(names, (F.col("prediction") + 1).cast("int"))
    own = F.element_at(names, (F.col("label") + 1).cast("int"))
    ok = (text == F.col(f"`predicted-{target}`")) & (own == F.col(target))
    rows = preds.select(target, F.coalesce(ok, F.lit(False)).alias("ok"))
    if rest is not None:
        rows = rows.unionAll(rest.select(target, F.lit(True)))
    return rows.groupBy(target).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("n_consistent"))


def _beats_majority(rows, model, learned):
    """``rows`` and whether the model knows more of the labels it learned from than their most frequent one."""
    return _with_majority(rows, H.predict(model, learned))


def _with_majority(rows, preds):
    """``rows`` and whether the predictions ``preds`` are right more often than the most frequent label."""
    right = preds.agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"),
                                          F.avg((F.col("label") == 0).cast("double")).alias("m"))  # 0: the most frequent
    return rows.crossJoin(right.select((F.col("a") > F.col("m")).alias("beats_majority")))  # one row


def _tree_predictions(spark, sf, kind):
    prepared = materialize(_classify_prepared(spark, sf), "table")
    chain, _ = H.chain_raw(prepared, "high_value", kind)
    train, test = train_test_split(prepared, 0.8, 42)
    model = H.fit(chain, train)
    both = train.withColumn("_learned", F.lit(True)).unionAll(test.withColumn("_learned", F.lit(False)))
    # predicted in one pass, read by both checks
    preds = materialize(H.predict(model, both).select("high_value", "label", "prediction", "predicted-high_value", "_learned"), "table")
    return _with_majority(_consistent(preds.where("NOT _learned"), "high_value", H.best_pipeline(model).stages[1].labels, train),
                          preds.where("_learned"))


@query("decision_tree", sql=_ROWS_PER_LABEL)
def decision_tree_q(spark, sf):
    return _tree_predictions(spark, sf, "DT")


@query("random_forest", sql=_ROWS_PER_LABEL)
def random_forest_q(spark, sf):
    return _tree_predictions(spark, sf, "RF")


@query("gbt", sql=_ROWS_PER_LABEL)
def gbt_q(spark, sf):
    return _tree_predictions(spark, sf, "GBT")


@query("classifier_chain_raw", sql=_ROWS_PER_LABEL)
def classifier_chain_raw_q(spark, sf):
    prepared = materialize(_classify_prepared(spark, sf), "table")
    chain, _ = H.chain_raw(prepared, "high_value", "DT")
    model = H.fit(chain, prepared)
    return _beats_majority(_consistent(H.predict(model, prepared), "high_value", model.stages[1].labels), model, prepared)


@query("classifier_chain_vector", sql=X.with_fixture(
    "wide", "SELECT CAST(response AS VARCHAR) AS response, count(*) AS n_rows, count(*) AS n_consistent, "
            "true AS beats_majority FROM wide GROUP BY 1"))
def classifier_chain_vector_q(spark, sf):
    wide = materialize(X.wide(spark, sf).withColumn("response", F.col("response").cast("string")), "table")
    table, _, _, _ = J.measure_pca(wide)
    chain, _ = H.chain_vector(table, "response", "DT")
    train, _ = split_by_key(table, "id", 0.8)
    model = H.fit(chain, train)
    # reduced and predicted in one pass, read by both checks
    preds = materialize(H.predict(model, table).select("id", "response", "label", "prediction", "predicted-response"), "table")
    learned, _ = split_by_key(preds, "id", 0.8)
    return _with_majority(_consistent(preds, "response", model.stages[0].labels), learned)


@query("cross_validate", sql=X.with_fixture("classify", "," + _PREPARED + """
SELECT count(*) AS n_rows, true AS in_grid, true AS is_best, true AS accuracy_in_range FROM t"""))
def cross_validate_q(spark, sf):
    """Cross-validation over the whole grid: the winner is a grid point with the best fold mean."""
    prepared = materialize(_classify_prepared(spark, sf), "table")
    chain, clf = H.chain_raw(prepared, "high_value", "DT")
    train, test = train_test_split(prepared, 0.8, 42)
    grid = H.param_grid(clf, "DT")
    model = H.fit(chain, train, grid, validate=True, folds=3, parallelism=3, by_truncation=True)
    best = H.best_params(model)
    points = [(g[clf.maxDepth], g[clf.minInstancesPerNode]) for g in grid]
    won = points[max(range(len(grid)), key=lambda i: model.avgMetrics[i])]
    acc = M.accuracy(H.predict(model, test)).first()[0]
    got = (best["maxDepth"], best["minInstancesPerNode"])
    return prepared.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(got in points).alias("in_grid"), F.lit(got == won).alias("is_best"),
        F.lit(0 <= acc <= 1).alias("accuracy_in_range"))


_PREPARED_BINS = X.with_fixture("classify", """,
t AS (SELECT DISTINCT * FROM (
        SELECT loss, CAST(age AS INTEGER) AS age, nullif(nullif(trim(priority), '?'), '') AS priority,
               nullif(nullif(trim(segment), '?'), '') AS segment, nullif(nullif(trim(status), '?'), '') AS status,
               nullif(nullif(trim(nation), '?'), '') AS nation, hours, gain,
               nullif(nullif(trim(high_value), '?'), '') AS high_value FROM classify)
      WHERE age IS NOT NULL AND priority IS NOT NULL AND segment IS NOT NULL AND status IS NOT NULL
        AND nation IS NOT NULL AND hours IS NOT NULL AND gain IS NOT NULL AND loss IS NOT NULL AND high_value IS NOT NULL),
s AS (SELECT list_distinct(quantile_disc(gain, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS sp,
            list_distinct(quantile_disc(loss, [0.2, 0.4, 0.6, 0.8])) AS sl FROM t)
SELECT priority, segment, status, nation, high_value, """ + ", ".join([
    "CAST(CASE WHEN age >= 0 AND age < 18 THEN 0 WHEN age >= 18 AND age < 30 THEN 1 WHEN age >= 30 AND age < 60 "
    "THEN 2 WHEN age >= 60 AND age <= 100 THEN 3 END AS DOUBLE) AS age",
    "CAST(CASE WHEN hours >= 0 AND hours < 25 THEN 0 WHEN hours >= 25 AND hours < 40 THEN 1 WHEN hours >= 40 AND "
    "hours < 60 THEN 2 WHEN hours >= 60 AND hours <= 100 THEN 3 END AS DOUBLE) AS hours",
    "CAST(len(list_filter(sp, lambda v: v <= gain)) AS DOUBLE) AS gain",
    "CAST(len(list_filter(sl, lambda v: v <= loss)) AS DOUBLE) AS loss"]) + " FROM t, s").replace(
    ")\n,\nt AS", ")\n, t AS", 1)

_STUMP = """,
x AS MATERIALIZED (SELECT *, high_value = (SELECT max(high_value) FROM p) AS y FROM p),
u AS (UNPIVOT (SELECT y, CAST(age AS VARCHAR) AS age, CAST(hours AS VARCHAR) AS hours, CAST(gain AS VARCHAR) AS gain,
                      CAST(loss AS VARCHAR) AS loss, CAST(priority AS VARCHAR) AS priority, CAST(segment AS VARCHAR) AS segment,
                      CAST(status AS VARCHAR) AS status, CAST(nation AS VARCHAR) AS nation FROM x)
      ON age, hours, gain, loss, priority, segment, status, nation INTO NAME feature VALUE v),
g AS (SELECT feature, v, count(*) AS n, count(*) FILTER (y) AS n1 FROM u GROUP BY 1, 2),
c AS (SELECT feature, sum(n) OVER w AS nl, sum(n1) OVER w AS l1, sum(n) OVER (PARTITION BY feature) AS nt,
             sum(n1) OVER (PARTITION BY feature) AS t1 FROM g
      WINDOW w AS (PARTITION BY feature ORDER BY CAST(n1 AS DOUBLE) / n, v ROWS UNBOUNDED PRECEDING)),
h AS (SELECT feature, nl, l1, nt - nl AS nr, t1 - l1 AS r1, nt,
             nl * (-(CASE WHEN l1 IN (0, nl) THEN 0 ELSE l1 / nl * log2(l1 / nl) + (nl - l1) / nl * log2((nl - l1) / nl) END))
             + (nt - nl) * (-(CASE WHEN t1 - l1 IN (0, nt - nl) THEN 0 ELSE (t1 - l1) / (nt - nl) * log2((t1 - l1) / (nt - nl))
                + (nt - nl - t1 + l1) / (nt - nl) * log2((nt - nl - t1 + l1) / (nt - nl)) END)) AS rest
      FROM (SELECT feature, CAST(nl AS DOUBLE) AS nl, CAST(l1 AS DOUBLE) AS l1, CAST(nt AS DOUBLE) AS nt, CAST(t1 AS DOUBLE) AS t1 FROM c)
      WHERE nl >= 10 AND nt - nl >= 10),
best AS (SELECT * FROM h ORDER BY rest, feature LIMIT 1)
SELECT CAST(0 AS INTEGER) AS depth, count(*) AS n_rows, greatest(count(*) FILTER (y), count(*) FILTER (NOT y)) AS n_correct FROM x
UNION ALL
SELECT CAST(1 AS INTEGER), CAST(nt AS BIGINT), CAST(greatest(l1, nl - l1) + greatest(r1, nr - r1) AS BIGINT) FROM best"""


@query("tree_depth_curve", sql=_PREPARED_BINS.replace("SELECT priority, segment", ", p AS (SELECT priority, segment", 1) + ")" + _STUMP)
def tree_depth_curve_q(spark, sf):
    """H1/H6: a deep tree cut back to its root and to its first split, the one of the least entropy."""
    prepared = materialize(_classify_prepared(spark, sf), "table")
    chain, clf = H.chain_raw(prepared, "high_value", "DT")
    model = H.fit(chain, prepared)
    ready = PipelineModel(stages=model.stages[:-2]).transform(prepared)
    got = predictions_by_depth(model.stages[-2], ready, [0, 1], ["label"])
    right = [F.struct(F.lit(d).alias("depth"), (F.element_at("predictions", d + 1) == F.col("label")).alias("ok")) for d in (0, 1)]
    return (got.select(F.inline(F.array(*right))).groupBy("depth")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.count_if("ok").alias("n_correct")))


@query("tree_grid_scores")
def tree_grid_scores_q(spark, sf):
    """H6/H7: mean fold accuracy of every point of the grid, from one fit per fold and leaf size."""
    prepared = materialize(_classify_prepared(spark, sf), "table")
    chain, clf = H.chain_raw(prepared, "high_value", "DT")
    result = grid_by_truncation(chain, prepared, H.param_grid(clf, "DT"))
    rows = [(d, leaf, m, (d, leaf) == result.best) for (d, leaf), m in zip(result.points, result.avgMetrics)]
    return spark.createDataFrame(rows, "max_depth int, min_leaf int, accuracy double, chosen boolean")  # the grid's points


@query("two_stage_cv")
def two_stage_cv_q(spark, sf):
    """J8 with cross-validation: scores of each group, and the grid point that won there."""
    scores, _, model = J.two_stage(X.wide(spark, sf), "id", "response", k=6, kind="DT", validate=True)
    won = [(c, *v) for c, v in sorted(model.validated.items())]
    won = spark.createDataFrame(won, "cluster int, max_depth int, min_leaf int, fold_accuracy double")  # one row per group
    return scores.join(won, "cluster", "left")


@query("model_roundtrip_classifier", sql=X.with_fixture("classify", "," + _PREPARED + """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM t"""))
def model_roundtrip_classifier_q(spark, sf):
    """Predictions before and after storing the chain, over all rows."""
    prepared = materialize(_classify_prepared(spark, sf), "table").withColumn("row", F.monotonically_increasing_id())
    chain, _ = H.chain_raw(prepared.drop("row"), "high_value", "DT")
    model = H.fit(chain, prepared)
    loaded = load_classifier(save_classifier(model, scratch_dir(spark, "classifier")))
    one = model.transform(prepared).select("row", "prediction")
    two = loaded.transform(prepared).select("row", F.col("prediction").alias("again"))
    return one.join(two, "row").agg(F.count(F.lit(1)).alias("n_rows"),
                                    F.count_if(F.col("prediction") != F.col("again")).alias("n_different"))


@query("flow_classify_prepare", sql=_PREPARED_BINS)
def flow_classify_prepare_q(spark, sf):
    return _classify_prepared(spark, sf)


@query("flow_classify", sql=X.with_fixture("classify", "," + _PREPARED + """
SELECT true AS has_rows, true AS accuracy_agrees, true AS in_range FROM t LIMIT 1"""))
def flow_classify_q(spark, sf):
    """The whole classification flow (cross-validated): its scores against the predictions."""
    scores, _, preds = J.classify_flow(X.classify(spark, sf), kind="DT", validate=True)
    again = preds.agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a"))
    metrics = [F.col(c).between(-1, 1) for c in ("accuracy", "precision", "recall", "f1", "auroc", "mcc")]
    ok = metrics[0]
    for m in metrics[1:]:
        ok = ok & m
    return scores.crossJoin(again).select(  # one row each
        (F.col("n") > 0).alias("has_rows"), (F.abs(F.col("a") - F.col("accuracy")) < 1e-9).alias("accuracy_agrees"),
        ok.alias("in_range"))


@query("flow_common_prepare", sql=X.with_fixture("wide", "SELECT * FROM wide"))
def flow_common_prepare_q(spark, sf):
    """Columns that do not vary go, id and target stay."""
    w = X.wide(spark, sf)
    return J.common_prepare(w.withColumn("same", F.lit(1.0)).withColumn("never", F.lit(None).cast("double"))
                            .withColumn("once", F.when(F.col("id") % 2 == 0, F.lit(5.0))))


def _component_checks(out, n: int, keep: str):
    """All rows are there; components are centred, ordered by variance, and uncorrelated."""
    cov = FE.feature_covariance(out, [f"f{i}" for i in range(n)])  # one pass, any number of components
    own = F.col("i") == F.col("j")
    checks = cov.agg(F.sum(F.when(own, F.col("cov"))).alias("total"), F.max(F.when(~own, F.abs("cov"))).alias("most"),
                     F.array_sort(F.collect_list(F.when(own, F.struct("i", "cov")))).alias("of"))  # n of them
    falls = F.forall(F.sequence(F.lit(1), F.size("of")), lambda k: (k == F.size("of")) | (
        F.element_at("of", k)["cov"] >= F.coalesce(F.try_element_at("of", k + 1)["cov"], F.lit(0.0)) - 1e-9))
    return out.agg(F.count(keep).alias("n_rows")).crossJoin(checks.select(  # one row each
        falls.alias("ordered"), (F.coalesce("most", F.lit(0.0)) <= 1e-6 * F.greatest("total", F.lit(1.0))).alias("uncorrelated")))


_COMPONENTS_OK = "count(*) AS n_rows, true AS ordered, true AS uncorrelated"


@query("flow_presence_pca", sql=X.with_fixture("wide", f"SELECT {_COMPONENTS_OK} FROM wide"))
def flow_presence_pca_q(spark, sf):
    common = J.common_prepare(materialize(X.wide(spark, sf), "table"))
    out, pc, _ = J.presence_pca(common, "id", "response", 50, 0.95)
    return _component_checks(out, pc.numCols, "id")


@query("flow_measure_pca", sql=X.with_fixture("wide", f"SELECT {_COMPONENTS_OK} FROM wide"))
def flow_measure_pca_q(spark, sf):
    out, pc, _, _ = J.measure_pca(materialize(X.wide(spark, sf), "table"), "id", "response", 50, 0.95)
    return _component_checks(out, pc.numCols, "id")


@query("pca_components", sql=f"SELECT {_COMPONENTS_OK} FROM embeddings")
def pca_components_q(spark, sf):
    e = load_table(spark, sf, "embeddings")
    v = e.select("vec_id", array_to_vector("embedding").alias("features"))
    out, pc, _ = FE.pca(v, 10, assemble_features=False, standardize_features=True,
                        explained_variance=0.95, exclude=["vec_id"])
    return _component_checks(out, pc.numCols, "vec_id")


@query("two_stage_scores")
def two_stage_scores_q(spark, sf):
    scores, _, _ = J.two_stage(X.wide(spark, sf), "id", "response", k=6, kind="RF")
    return scores


@query("two_stage_score_new", sql=X.with_fixture("wide", f"""
SELECT id, true AS has_prediction FROM wide
WHERE ((id % {BUCKET_MOD}) * {BUCKET_MULT} + {BUCKET_ADD}) % {BUCKET_MOD} >= 0.8 * {BUCKET_MOD}"""))
def two_stage_score_new_q(spark, sf):
    """Every new row comes back once, with a prediction."""
    seen, new = split_by_key(X.wide(spark, sf), "id", 0.8)
    _, _, model = J.two_stage(seen, "id", "response", k=6, kind="DT")
    out = J.score_new(model, new)
    return out.select("id", (F.col("prediction").isNotNull() & F.col("predicted").isin("0", "1")).alias("has_prediction"))


@query("two_stage_totals", sql=X.with_fixture("wide", """
SELECT count(*) AS n_rows, CAST(sum(response) AS BIGINT) AS n_failures, CAST(count(*) - sum(response) AS BIGINT) AS n_others,
       CAST(0 AS BIGINT) AS n_different FROM wide"""))
def two_stage_totals_q(spark, sf):
    """Rows and classes of all groups add up to the table; the stored model predicts the same."""
    w = materialize(X.wide(spark, sf), "table")  # fitted and scored twice
    scores, _, model = J.two_stage(w, "id", "response", k=6, kind="DT", written=True)
    loaded = J.TwoStageModel.load(model.save(scratch_dir(spark, "two-stage")))
    one, two = J.score_new(model, w), J.score_new(loaded, w).withColumnRenamed("prediction", "again")
    diff = one.join(two.select("id", "again"), "id").agg(
        F.count_if(~F.col("prediction").eqNullSafe(F.col("again"))).alias("n_different"))
    return scores.agg(F.sum("n_rows").alias("n_rows"), F.sum("n_failures").alias("n_failures"),
                      F.sum("n_others").alias("n_others")).crossJoin(diff)  # one row each


@query("gap_curve", sql=X.with_fixture("customers", """
SELECT CAST(2 AS INTEGER) AS first_k, true AS consecutive, true AS deviations_ok, true AS stops_by_rule FROM customers LIMIT 1"""))
def gap_curve_q(spark, sf):
    """The gap statistic per k from real k-means fits (30 reference draws each); the search
    stops at the first k whose gap is not beaten."""
    prepared = materialize(_arrest_like(spark, sf), "table")
    k, _, history = G.find_num_clusters(prepared, "features", 2, 10, 30, 42)
    ks = [h[0] for h in history]
    beaten = [a[1] > b[1] - b[2] for a, b in zip(history, history[1:])]
    stops = (not any(beaten[:-1])) and (k == ks[-2] if beaten and beaten[-1] else k == ks[-1])
    rows = [(min(ks), ks == list(range(2, ks[-1] + 1)), all(h[2] >= 0 for h in history), bool(stops))]
    return spark.createDataFrame(rows, "first_k int, consecutive boolean, deviations_ok boolean, stops_by_rule boolean")


@query("gap_curve_values")
def gap_curve_values_q(spark, sf):
    """Per k the gap, its deviation and the log inertia, all draws of a k fitted together."""
    prepared = materialize(_arrest_like(spark, sf), "table")
    _, _, history = G.find_num_clusters(prepared, "features", 2, 10, 30, 42)
    return spark.createDataFrame(history, "k int, gap double, s double, log_w double")  # one row per k


_PRESENCE = [f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in X.WIDE_FEATURES]
_COV_WIDE = "SELECT " + ", ".join(
    f"covar_samp({_PRESENCE[i]}, {_PRESENCE[j]}) AS cov_{i}_{j}"
    for i in range(len(_PRESENCE)) for j in range(i, len(_PRESENCE))) + " FROM wide"


@query("feature_covariance", sql=X.with_fixture("wide", f""", cw AS ({_COV_WIDE}),
u AS (UNPIVOT cw ON COLUMNS(*) INTO NAME name VALUE v)
SELECT CAST(split_part(name, '_', 2) AS INTEGER) AS i, CAST(split_part(name, '_', 3) AS INTEGER) AS j,
       round(v, 6) + 0.0 AS cov FROM u"""))
def feature_covariance_q(spark, sf):
    """F5's input check: sample covariance of the presence flags the clustering PCA uses
    (upper triangle, from one distributed Gramian pass)."""
    flags = J.presence_flags(X.wide(spark, sf))
    names = [f"_p_{c}" for c in X.WIDE_FEATURES]
    cov = FE.feature_covariance(flags, names)
    return cov.select("i", "j", r6(F.col("cov")).alias("cov"))
