"""Features (F) and clustering (G): invariants and equivalences."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_TINY
from flawscope.operators import clustering as G
from flawscope.operators import features as FE
from flawscope.plans import flows as J
from flawscope.sources import fixtures as X
from flawscope.sources.tables import load_table


def test_binning_edges_and_out_of_range(spark):
    df = spark.createDataFrame([(0,), (17,), (18,), (60,), (100,)], "age int")
    out, _ = FE.binning(df, "age", [0, 18, 30, 60, 100])
    assert [r.age for r in out.collect()] == [0.0, 0.0, 1.0, 3.0, 3.0]
    bad = spark.createDataFrame([(101,)], "age int")
    with pytest.raises(Exception):
        FE.binning(bad, "age", [0, 18, 30, 60, 100])[0].collect()


def test_quantile_bins_collapse_to_one_bucket(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("g"))
    assert FE.quantile_splits(df, "g", 10) == [float("-inf"), 0.0, float("inf")]
    out, _ = FE.quantile_bins(df, "g", 10)
    assert {r.g for r in out.collect()} == {1.0}


def test_quantile_bins_exact_equals_spark_relative_error_zero(spark):
    li = load_table(spark, SF_SMALL, "lineitem").select("l_extendedprice")
    ours, _ = FE.quantile_bins(li, "l_extendedprice", 7, exact=True)
    spark_, _ = FE.quantile_bins(li, "l_extendedprice", 7, exact=False, relative_error=0.0)
    a = sorted(r[0] for r in ours.collect())
    b = sorted(r[0] for r in spark_.collect())
    assert a == b


@pytest.mark.parametrize("shares,limit,at_most,at_least", [
    ([0.5, 0.3, 0.1, 0.1], 0.95, 3, 4),
    ([0.6, 0.4], 0.6, 1, 1),
    ([0.97, 0.03], 0.95, 2, 1),
    ([0.4, 0.3, 0.2, 0.1], 0.95, 3, 4),
])
def test_choose_components_rules(shares, limit, at_most, at_least):
    assert FE.choose_components(shares, limit, "at_most") == at_most
    assert FE.choose_components(shares, limit, "at_least") == at_least


def test_pca_invariants(spark):
    e = load_table(spark, SF_SMALL, "embeddings")
    v = e.select("vec_id", array_to_vector("embedding").alias("features"))
    out, pc, stages = FE.pca(v, 8, assemble_features=False, standardize_features=True,
                             explained_variance=0.999, exclude=["vec_id"])
    w = pc.toArray()
    n = w.shape[1]
    assert np.allclose(w.T @ w, np.eye(n), atol=1e-8)
    ev = stages["pca"].explainedVariance.toArray()
    assert all(ev[i] >= ev[i + 1] - 1e-12 for i in range(len(ev) - 1)) and ev.sum() <= 1 + 1e-9
    assert out.columns == ["features", "vec_id", *[f"f{i}" for i in range(n)]]
    # projection of standardised data: variance of component i = share_i * d
    var0 = out.agg(F.var_samp("f0")).first()[0]
    assert abs(var0 - ev[0] * 64) < 1e-6 * 64
    # the replay chain gives the same projection
    replay = stages["chain"].transform(v).select("vec_id", vector_to_array("_proj")[0].alias("p0"))
    a = dict((r.vec_id, r.f0) for r in out.select("vec_id", "f0").collect())
    assert all(abs(a[r.vec_id] - r.p0) < 1e-9 for r in replay.collect())


def test_project_fixed_paths_agree_with_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 80))
    w = rng.normal(size=(80, 60))  # 4,800 terms: Arrow path
    df = spark.createDataFrame([(i, x[i].tolist()) for i in range(20)], "id int, v array<double>")
    got = FE.project_fixed(df, "v", w.tolist(), keep=["id"]).orderBy("id").collect()
    expect = x @ w
    assert np.allclose([[r[f"c{j}"] for j in range(60)] for r in got], expect)
    small = FE.project_fixed(df, "v", w[:, :2].tolist(), keep=["id"]).orderBy("id").collect()
    assert np.allclose([[r.c0, r.c1] for r in small], expect[:, :2])


def test_index_features_ties_alphabetical(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "s string")
    out, model = FE.index_features(df, ["s"])
    assert model.labelsArray[0] == ["c", "a", "b"]
    labelled = FE.index_to_label(out.withColumnRenamed("indexed-s", "prediction"), model.labelsArray[0],
                                 target="s")
    assert all(r.s == r["predicted-s"] for r in labelled.collect())


def _arrests(spark):
    prepared, _ = J.prepare_cluster_table(X.cluster(spark, SF_TINY), "city")
    return prepared


def test_kmeans_assignment_is_nearest_and_inertia(spark):
    df = _arrests(spark)
    model = G.kmeans_fit(df, 3)
    centres = G.centers_of(model)
    assigned = model.transform(df)
    near = G.nearest_center(assigned, centres, keep=["city", "prediction"]).collect()
    assert all(r.nearest == r.prediction for r in near)
    pts = np.array([r.features.toArray() for r in df.collect()])
    d = ((pts[:, None, :] - np.array(centres)[None, :, :]) ** 2).sum(-1)
    assert abs(G.inertia_value(df, centres) - d.min(1).sum()) < 1e-9
    total = ((pts - pts.mean(0)) ** 2).sum()
    assert G.inertia_value(df, centres) <= total


def test_nearest_center_first_wins_ties(spark):
    df = spark.createDataFrame([([0.0, 0.0],)], "v array<double>")
    out = G.nearest_center(df, [[1.0, 0.0], [-1.0, 0.0]], "v", is_vector=False).first()
    assert (out.nearest, out.cost) == (0, 1.0)


def test_silhouette_single_cluster_is_none(spark):
    df = _arrests(spark).withColumn("prediction", F.lit(0))
    assert G.silhouette_value(df) is None


def test_choose_k_rule(spark):
    gaps = spark.createDataFrame([(2, 1.0, 0.1), (3, 1.5, 0.1), (4, 1.45, 0.2), (5, 2.0, 0.1)],
                                 "k int, gap double, s double")
    assert G.choose_k(gaps).first()[0] == 3
    never = spark.createDataFrame([(2, 1.0, 0.0), (3, 2.0, 0.0)], "k int, gap double, s double")
    assert G.choose_k(never).first()[0] == 3


def test_gap_search_finds_separated_blobs(spark):
    rng = np.random.default_rng(3)
    centres = np.array([[0, 0], [10, 0], [0, 10]])
    pts = np.vstack([c + rng.normal(scale=0.3, size=(30, 2)) for c in centres])
    df = spark.createDataFrame([(p.tolist(),) for p in pts], "v array<double>") \
        .select(array_to_vector("v").alias("features")).repartition(2)
    k, model, history = G.find_num_clusters(df, max_k=6, num_random=5, parallelism=4)
    assert k == 3
    assert len(G.centers_of(model)) == 3
    assert [h[0] for h in history][:2] == [2, 3]


def test_reference_uniform_stays_in_box(spark):
    df = _arrests(spark)
    ranges = G.feature_ranges(df)
    ref = G.reference_uniform(df, ranges, seed=7)
    arr = np.array([r.features.toArray() for r in ref.collect()])
    lo, hi = np.array([a for a, _ in ranges]), np.array([b for _, b in ranges])
    assert arr.shape == (df.count(), len(ranges))
    assert (arr >= lo - 1e-12).all() and (arr <= hi + 1e-12).all()
