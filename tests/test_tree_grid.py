"""Grids by cutting back deep trees, and flows on tables without rows or with infinite values."""

import pytest
from conftest import SF_TINY
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from flawscope.operators import classify as H
from flawscope.operators.tree_grid import can_cut_back, grid_by_truncation, predictions_by_depth
from flawscope.plans import flows as J
from flawscope.session import materialize
from flawscope.sources import fixtures as X


@pytest.fixture(scope="module")
def rows(spark):
    """A label that follows two features and a category, with noise; f is the fold."""
    d = spark.range(3000, numPartitions=4).select(
        "id", (F.abs(F.xxhash64("id", F.lit(1))) % 100 / 10).alias("a"), (F.abs(F.xxhash64("id", F.lit(2))) % 7).cast("string").alias("b"),
        (F.abs(F.xxhash64("id", F.lit(3))) % 50).cast("double").alias("c"), F.pmod(F.xxhash64("id", F.lit(4)), F.lit(3)).cast("int").alias("f"))
    odd = F.abs(F.xxhash64("id", F.lit(5))) % 10 == 0
    y = ((F.col("a") > 4) & F.col("b").isin("1", "4", "6")) | (F.col("c") < 12)
    return materialize(d.withColumn("y", F.when(odd, ~y).otherwise(y).cast("string")), "table")


def chain_of(df, kind, **settings):
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    lab, back = H.label_stages(df, "y")
    idx = StringIndexer(inputCol="b", outputCol="ib").fit(df)
    clf = H.make_classifier(kind, settings=H.TreeSettings(**settings))
    return Pipeline(stages=[lab, idx, VectorAssembler(inputCols=["a", "ib", "c"], outputCol="features"), clf, back]), clf


def test_scores_of_a_grid_equal_cross_validation(spark, rows):
    chain, clf = chain_of(rows, "DT")
    grid = ParamGridBuilder().addGrid(clf.maxDepth, [1, 3, 8]).addGrid(clf.minInstancesPerNode, [1, 25]).build()
    got = grid_by_truncation(chain, rows, grid, 3, fold_col="f")
    cv = CrossValidator(estimator=chain, estimatorParamMaps=grid, evaluator=H.evaluator(), numFolds=3, parallelism=3, foldCol="f").fit(rows)
    assert got.avgMetrics == pytest.approx(cv.avgMetrics, abs=1e-12)
    assert got.n_fits == 2 * 3 + 1
    best = H.best_params(got)
    assert got.best == (best["maxDepth"], best["minInstancesPerNode"]) == tuple(H.best_params(cv).values())
    assert max(cv.avgMetrics) > 0.85


def test_each_depth_answers_as_a_refit(spark, rows):
    chain, clf = chain_of(rows, "DT", max_depth=9, min_leaf=5)
    model = chain.fit(rows)
    ready = PipelineModel(stages=model.stages[:-2]).transform(rows)
    got = {r["id"]: r["predictions"] for r in predictions_by_depth(model.stages[-2], ready, [0, 2, 5, 9], ["id"]).collect()}
    for k, depth in enumerate((0, 2, 5, 9)):
        again = clf.copy({clf.maxDepth: depth}).fit(ready).transform(ready).select("id", "prediction").collect()
        assert all(got[r["id"]][k] == r["prediction"] for r in again)


def test_forest_at_its_own_depth_answers_as_the_model(spark, rows):
    model = chain_of(rows, "RF", max_depth=6, num_trees=11)[0].fit(rows)
    ready = model.transform(rows).withColumn("gap", F.abs(F.element_at(vector_to_array("rawPrediction"), 1) - 5.5))
    got = predictions_by_depth(model.stages[-2], ready, [6, 1], ["prediction", "gap"])
    assert got.where("predictions[0] <> prediction and gap > 1e-9").count() == 0
    assert got.where("predictions[1] <> prediction").count() > 0  # one split answers otherwise


def test_folds_without_rows_and_hash_folds(spark, rows):
    chain, clf = chain_of(rows, "DT")
    grid = ParamGridBuilder().addGrid(clf.maxDepth, [1, 4]).addGrid(clf.minInstancesPerNode, [5]).build()
    one = grid_by_truncation(chain, rows.withColumn("f", F.lit(0)), grid, 3, fold_col="f")
    assert one.n_fits == 2 and all(0 < m <= 1 for m in one.avgMetrics)
    a, b = (grid_by_truncation(chain, r.drop("f"), grid, 3, seed=1).avgMetrics for r in (rows, rows.repartition(7)))
    assert a == b  # dealt by what a row holds, not by where it is
    two = grid_by_truncation(chain, rows.withColumn("f", F.col("id").cast("int") % 2), grid, 3, fold_col="f")
    assert two.n_fits == 3


def test_what_can_be_cut_back(rows):
    assert can_cut_back(chain_of(rows, "RF")[0]) and not can_cut_back(Pipeline(stages=[GBTClassifier()]))
    with pytest.raises(ValueError):
        grid_by_truncation(Pipeline(stages=[GBTClassifier()]), rows, [])
    assert can_cut_back(Pipeline(stages=[DecisionTreeClassifier()]))


def test_two_stage_validated_and_no_new_rows(spark):
    w = X.wide(spark, SF_TINY)
    settings = H.TreeSettings(max_depth=6, min_leaf=3)
    scores, _, model = J.two_stage(w, k=2, kind="DT", validate=True, settings=settings)
    assert set(model.validated) == set(model.per_cluster) and scores.count() == 2
    for depth, leaf, accuracy in model.validated.values():
        assert depth in (1, 6) and leaf in (1, 3) and 0 < accuracy <= 1
    out = J.score_new(model, w.limit(0))
    assert out.count() == 0 and out.columns == ["id", "cluster", "prediction", "predicted"]


def test_infinite_measurements_are_missing(spark):
    rows = [(i, i % 2, float(i % 5) if i % 7 else float("inf"), float(i % 3) if i % 11 else float("-inf"),
             float("nan") if i % 2 else 1.0 * i) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, response int, a double, b double, c double")
    stats = J.group_stats(df.withColumn("g", F.lit(0)), "g", ["a", "b", "c"])[0]
    finite = [r[2] for r in rows if r[2] != float("inf")]
    assert stats["a"] == pytest.approx(sum(finite) / len(finite))
    out, _, _, n = J.measure_pca(df)
    assert out.count() == 60 and out.where(" or ".join(f"not abs(f{i}) < 1e9" for i in range(n))).count() == 0


def test_component_check_of_many_components(spark):
    from flawscope.plans.queries_models import _component_checks

    names = [f"x{i}" for i in range(60)]
    df = spark.range(300).select("id", *[(F.xxhash64("id", F.lit(i)) % 1000 / 100).alias(n) for i, n in enumerate(names)])
    from flawscope.operators.features import pca

    out, pc, _ = pca(df, 60, exclude=["id"], explained_variance=1.0)
    assert pc.numCols >= 50
    assert tuple(_component_checks(out, pc.numCols, "id").first()) == (300, True, True)
    mixed = out.withColumn("f1", F.col("f0") + F.col("f1"))
    assert not _component_checks(mixed, pc.numCols, "id").first()["uncorrelated"]


def test_a_cross_validated_grid_predicts_and_is_stored(spark, rows, tmp_out):
    from flawscope.sources.models import load_classifier, save_classifier

    chain, clf = chain_of(rows, "DT")
    grid = ParamGridBuilder().addGrid(clf.maxDepth, [1, 4]).addGrid(clf.minInstancesPerNode, [5]).build()
    model = H.fit(chain, rows, grid, validate=True, by_truncation=True)
    got = H.predict(model, rows).select("id", "prediction")
    again = load_classifier(save_classifier(model, tmp_out)).transform(rows).select("id", F.col("prediction").alias("again"))
    assert got.join(again, "id").where("prediction = again").count() == rows.count()
