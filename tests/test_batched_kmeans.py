"""k-means of many tables in the same jobs."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from flawscope.operators import clustering as G
from flawscope.operators.batched_kmeans import _far_points, batched_kmeans, distances, in_blocks, plus_plus
from flawscope.session import materialize


def tables(spark, points: dict, parts: int = 3):
    rows = [(d, p.tolist()) for d, ps in points.items() for p in ps]
    return materialize(in_blocks(spark.createDataFrame(rows, "draw int, x array<double>").repartition(parts)), "table")


def blobs(seed, centres, n, scale=0.2):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(c, scale, (n, len(c))) for c in centres])


def test_each_draw_gets_its_own_optimum(spark):
    where = {0: [[0, 0], [9, 0], [0, 9]], 4: [[-5, -5], [5, 5], [5, -5]], 7: [[1, 1], [30, 1], [1, 40]]}
    points = {d: blobs(d, c, 80) for d, c in where.items()}
    got = batched_kmeans(tables(spark, points), 3, seed=5)
    assert set(got) == set(where)
    for d, (centres, inertia) in got.items():
        assert np.allclose(sorted(centres.round(0).tolist()), sorted(where[d]), atol=0.01)
        assert inertia == pytest.approx(distances(points[d], centres).min(axis=1).sum())


def test_result_is_at_rest_and_as_good_as_one_fit_per_table(spark):
    rng = np.random.default_rng(2)
    points = {b: rng.uniform(0, 1, (600, 3)) for b in range(4)}
    got = batched_kmeans(tables(spark, points), 5, max_iter=100, tol=1e-9)
    for b, (centres, inertia) in got.items():
        near = distances(points[b], centres).argmin(axis=1)
        assert np.allclose(centres, [points[b][near == c].mean(axis=0) for c in range(5)], atol=1e-6)
        df = spark.createDataFrame([(p.tolist(),) for p in points[b]], "v array<double>").select(array_to_vector("v").alias("features"))
        one = G.inertia_value(df, G.centers_of(G.kmeans_fit(df, 5)))
        assert inertia < 1.15 * one


def test_jobs_do_not_depend_on_the_number_of_draws(spark):
    rng = np.random.default_rng(3)
    sc, jobs = spark.sparkContext, {}
    for n in (2, 12):
        t = tables(spark, {b: rng.uniform(0, 1, (50, 2)) for b in range(n)}, 2)
        sc.setJobGroup(f"draws-{n}", "k-means of draws")
        batched_kmeans(t, 3, max_iter=2, tol=0.0)
        jobs[n] = len(sc.statusTracker().getJobIdsForGroup(f"draws-{n}"))
        sc.setJobGroup("", "")
    assert 0 < jobs[12] <= jobs[2] + 6


def test_few_distinct_points_and_no_points(spark):
    same = {0: np.array([[1.0, 1.0]] * 9), 1: np.array([[0.0, 0.0], [4.0, 4.0]] * 5)}
    got = batched_kmeans(tables(spark, same), 3)
    assert got[0][0].tolist() == [[1.0, 1.0]] and got[0][1] == 0
    assert sorted(got[1][0].tolist()) == [[0.0, 0.0], [4.0, 4.0]] and got[1][1] == 0
    assert batched_kmeans(tables(spark, {0: np.ones((1, 2))}).limit(0), 2) == {}
    assert plus_plus(np.array([[0.0], [9.0]]), np.array([1.0, 3.0]), 2, 1).sum() == 9


def test_samples_are_drawn_by_distance_and_again_alike(spark):
    t = tables(spark, {0: np.array([[0.0]] * 50 + [[1.0]] * 50 + [[100.0]] * 50)})
    far = [_far_points(t, {0: np.array([[0.0]])}, 30, seed)[0] for seed in (1, 1, 2)]
    assert np.array_equal(far[0], far[1]) and not np.array_equal(far[0].sum(), 0)
    assert all((f == 100).mean() > 0.95 for f in far)  # ten thousand times the weight of 1, and 0 never
    assert all((f > 0).all() for f in far)


def test_search_with_batched_and_single_fits_agrees(spark):
    df = spark.createDataFrame([(p.tolist(),) for p in blobs(9, [[0, 0], [8, 0], [0, 8], [8, 8]], 40)], "v array<double>") \
        .select(array_to_vector("v").alias("features"))
    found = [G.find_num_clusters(df, max_k=6, num_random=6, batched=b) for b in (True, False)]
    assert found[0][0] == found[1][0] == 4
    for a, b in zip(found[0][2], found[1][2]):
        assert a[0] == b[0] and a[3] == b[3] and abs(a[1] - b[1]) < 0.2


def test_both_forms_of_the_nearest_centre(spark):
    rng = np.random.default_rng(1)
    x, centres = rng.normal(size=(60, 8)), rng.normal(size=(6, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    few = {r["id"]: (r["nearest"], r["cost"]) for r in G.nearest_center(df, centres.tolist(), "v", ["id"], False).collect()}
    many, G.PLAIN_TERMS = G.PLAIN_TERMS, 0
    try:
        lots = {r["id"]: (r["nearest"], r["cost"]) for r in G.nearest_center(df, centres.tolist(), "v", ["id"], False).collect()}
    finally:
        G.PLAIN_TERMS = many
    assert few == lots
    assert df.select(F.count("*")).first()[0] == len(few)
