"""No row, group or digit is lost: fractions, null groups, continuous scores, big integers, tiny
groups, unknown groups, wide tables, many groups."""

import math

import pytest
from conftest import SF_SMALL, SF_TINY
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flawscope.operators import classify as H
from flawscope.operators import clean as B
from flawscope.operators import clustering as G
from flawscope.operators import features as FE
from flawscope.operators import metrics as M
from flawscope.operators import sampling as E
from flawscope.operators import stats as D
from flawscope.plans import flows as J
from flawscope.sources import fixtures as X
from flawscope.sources.tables import load_table


@pytest.mark.parametrize("p", [0.003, 0.004, 0.005, 0.5, 0.999])
def test_small_and_large_fractions(spark, p):
    df = spark.range(100_000)
    n = E.take_subset_by_key(df, "id", p).count()
    assert abs(n - 100_000 * p) <= 5 * math.sqrt(100_000 * p * (1 - p)) + 1
    labels = dict(E.split_label_by_key(df, "id", p).groupBy("split").count().collect())
    assert labels == {"train": n, "test": 100_000 - n}
    train, test = E.split_by_key(df.union(spark.sql("SELECT CAST(NULL AS BIGINT)")), "id", p)
    assert (train.count(), test.count()) == (n, 100_001 - n)


def _scored(spark, n=20_000):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("g"), F.col("id") % 3)).alias("g"),
        F.rand(3).alias("score"), (F.rand(5) < 0.4).cast("double").alias("label"),
        (F.rand(7) < 0.5).cast("double").alias("prediction")).cache()


def test_score_table_keeps_the_null_group_and_exact_areas(spark):
    df = _scored(spark)
    got = {r["g"]: r for r in M.score_table(df, score="score", by="g").collect()}
    assert set(got) == {None, "g1", "g2"}
    for g, r in got.items():
        part = df.where(F.col("g").eqNullSafe(F.lit(g)))
        ev = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(part)
        assert abs(r["auroc"] - ev) < 1e-9
        assert abs(r["accuracy"] - M.accuracy(part).first()[0]) < 1e-12
    alone = M.score_table(df.limit(0), score="score").collect()
    assert len(alone) == 1 and alone[0]["accuracy"] is None


def test_score_table_of_many_groups_is_one_plan(spark):
    df = _scored(spark, 30_000).withColumn("g", (F.rand(9) * 12_000).cast("int"))
    out = M.score_table(df, score="score", by="g")
    assert out.count() == df.select("g").distinct().count() > 10_000
    assert "Union" not in out._jdf.queryExecution().executedPlan().toString()


def test_other_evaluator_metrics(spark):
    df = _scored(spark, 2000)
    assert abs(M.evaluator_metric(df, "accuracy") - M.accuracy(df).first()[0]) < 1e-12


def test_bigint_quantiles_and_medians_are_exact(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big,), (big,), (big + 2,), (None,)], "x bigint")
    assert D.exact_quantiles(df, ["x"], [0.5])["x"] == [big]
    out, _ = B.impute_exact_median(df)
    assert [r[0] for r in out.collect()] == [big, big, big + 2, big]


def test_wide_table(spark):
    """As many columns as the production table: 968 measurements."""
    names = [f"m{i}" for i in range(968)]
    df = spark.range(200).select("id", *[F.when((F.col("id") + i) % 5 == 0, None).otherwise(
        F.lit(1.0) if i % 50 == 0 else (F.col("id") * (i + 1) % 97).cast("double")).alias(c)
        for i, c in enumerate(names)]).cache()
    rows = [r.asDict() for r in df.collect()]
    med = D.exact_quantiles(df, names, [0.5])
    for c in names[::97]:
        v = sorted(r[c] for r in rows if r[c] is not None)
        assert med[c] == [v[math.ceil(len(v) / 2) - 1]]
    kept = B.drop_constant_columns(df, exclude=["id"]).columns
    constant = [c for i, c in enumerate(names) if i % 50 == 0 or (i + 1) % 97 == 0]
    assert [c for c in names if c not in kept] == constant
    nulls = D.count_nulls(df, names).first()
    assert all(nulls[c] == sum(r[c] is None for r in rows) for c in names[::97])
    means = J.group_stats(df.withColumn("g", F.lit(0)), "g", names)[0]
    assert len(means) == 968 - len(constant)
    flags = B.binary_conversion(df, exclude=["id"]).agg(F.sum("m1")).first()[0]
    assert flags == sum(r["m1"] is not None for r in rows)
    assert len(D.column_ranges(df, names).columns) == 2 * 968


def test_nearest_centre_and_projection_are_one_form(spark):
    import numpy as np
    rng = np.random.default_rng(1)
    x, centres = rng.normal(size=(100, 64)), rng.normal(size=(32, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    out = G.nearest_center(df, centres.tolist(), "v", keep=["id"], is_vector=False)
    d = ((x[:, None] - centres[None]) ** 2).sum(2)
    for r in out.collect():
        assert r["nearest"] == d[r["id"]].argmin() and abs(r["cost"] - d[r["id"]].min()) < 1e-9
    wide, w = rng.normal(size=(5, 968)), rng.normal(size=(968, 50))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(wide)], "id int, v array<double>")
    out = FE.project_fixed(df, "v", w.tolist(), keep=["id"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in out.collect():
        assert np.allclose([r[f"c{j}"] for j in range(50)], wide[r["id"]] @ w)


def test_names_that_look_like_temporary_ones(spark):
    df = spark.createDataFrame([(5, 1.0, 2.0, 0), (20, 3.0, 4.0, 1)], "age int, Tage double, _binned_age double, _mid int")
    out, _ = FE.binning(df, "age", [0, 18, 100])
    assert sorted(out.columns) == ["Tage", "_binned_age", "_mid", "age"]
    out, _ = FE.quantile_bins(df, "Tage", 2)
    assert out.count() == 2
    from flawscope.operators.combine import add_row_index
    assert [r["index"] for r in add_row_index(df, ["age"]).orderBy("age").collect()] == [0, 1]


def test_gap_search_with_few_distinct_points(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([5.0, 5.0],)] * 20, "v array<double>") \
        .select(array_to_vector("v").alias("features"))
    k, model, history = G.find_num_clusters(df, num_random=3, parallelism=2)
    assert k == 2 and history[-1][3] == -math.inf and len(G.centers_of(model)) == 2


def test_columns_with_too_many_labels_are_refused(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("name"), (F.col("id") % 2).cast("string").alias("y"))
    with pytest.raises(ValueError, match="name"):
        H.chain_raw(df, "y", max_categories=1000)
    with pytest.raises(ValueError, match="name"):
        FE.index_features(df, ["name"], max_categories=1000)


def test_split_by_value_limit_is_the_callers(spark):
    df = spark.range(1500).withColumn("g", F.col("id") % 1200)
    assert len(B.split_by_value(df, "g")) == 1200
    with pytest.raises(ValueError):
        B.split_by_value(df, "g", max_groups=1000)


@pytest.mark.parametrize("n_odd", [1, 2, 3])
def test_two_stage_survives_tiny_groups(spark, n_odd):
    base = spark.range(400).select(
        "id", F.when(F.col("id") < 400 - n_odd, F.col("id") * 7 % 31).cast("double").alias("a"),
        F.when(F.col("id") < 400 - n_odd, F.col("id") * 5 % 17).cast("double").alias("b"),
        F.when(F.col("id") >= 400 - n_odd, F.lit(3.0)).alias("c"),
        (F.col("id") * 3 % 11).cast("double").alias("d"),
        (F.col("id") % 3 == 0).cast("int").alias("response"))
    scores, summary, model = J.two_stage(base, k=2, kind="DT")
    rows = scores.collect()
    assert sum(r.n_rows for r in rows) == 400 and len(rows) == 2
    assert sum(r.n_failures for r in rows) == 134 == summary.first().n_failures
    new = J.score_new(model, base)
    assert new.count() == 400 and new.where("prediction IS NULL").count() == 0
    one = min(rows, key=lambda r: r.n_rows)
    assert one.n_rows == n_odd and (n_odd > 1 or one.cluster in model.majority)


def test_rows_of_an_unknown_group_are_kept(spark):
    w = X.wide(spark, SF_TINY)
    _, _, model = J.two_stage(w, k=3, kind="DT")
    gone = next(iter(model.per_cluster))
    model.per_cluster.pop(gone)
    out = J.score_new(model, w)
    assert out.count() == w.count()
    assert out.where("prediction IS NULL").select("cluster").distinct().collect() == [(gone,)]


def test_two_stage_model_is_stored_and_used(spark, tmp_out):
    w = X.wide(spark, SF_TINY)
    first, _, model = J.two_stage(w, k=3, kind="DT", store=tmp_out)
    again, _, loaded = J.two_stage(w, k=3, kind="DT", store=tmp_out)
    assert loaded.measures == model.measures and loaded is not model
    key = lambda df: sorted((r.cluster, r.n_rows, r.accuracy, r.auroc) for r in df.collect())
    assert key(first) == key(again)
    fresh = J.TwoStageModel.load(tmp_out)
    a, b = J.score_new(model, w), J.score_new(fresh, w).withColumnRenamed("prediction", "p2")
    assert a.join(b, "id").where("prediction <> p2").count() == 0 and a.count() == b.count() == w.count()


def test_flows_use_stored_models(spark, tmp_out):
    c = X.customers(spark, SF_TINY)
    _, one, _, history = J.cluster_flow(c, "id", max_k=3, num_random=3, store=tmp_out + "/km")
    _, two, _, none = J.cluster_flow(c, "id", max_k=3, num_random=3, store=tmp_out + "/km")
    assert one.first() == two.first() and history and not none
    t = X.classify(spark, SF_TINY)
    J.classify_flow(t, kind="DT", store=tmp_out + "/dt")
    scores, model, _ = J.classify_flow(t, kind="DT", store=tmp_out + "/dt")
    assert 0 <= scores.first().accuracy <= 1 and type(model).__name__ == "PipelineModel"


def test_continuous_score_matches_evaluator(spark):
    li = load_table(spark, SF_SMALL, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_returnflag") == "R").cast("double").alias("label"))
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(li)
    assert abs(M.auroc_value(li, "score") - ev) < 1e-9
