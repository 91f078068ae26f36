"""Metrics (I), classifiers (H), flows (J), streaming scoring, entry contract."""

from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from conftest import SF_SMALL, SF_TINY
from flawscope.operators import classify as H
from flawscope.operators import metrics as M
from flawscope.operators.sampling import key_below, split_by_key
from flawscope.plans import flows as J
from flawscope.sources import fixtures as X
from flawscope.sources.models import load_classifier, save_classifier
from flawscope.sources.tables import load_table


def _pred(spark):
    return X.pred(spark, SF_SMALL)


def test_weighted_scores_match_spark_evaluator(spark):
    p = _pred(spark)
    ours = M.multiclass_scores(p).first()
    for ours_name, spark_name in [("f1", "f1"), ("accuracy", "accuracy"),
                                  ("weighted_precision", "weightedPrecision"),
                                  ("weighted_recall", "weightedRecall"), ("hamming_loss", "hammingLoss")]:
        ev = MulticlassClassificationEvaluator(metricName=spark_name).evaluate(p)
        assert abs(ours[ours_name] - ev) < 1e-12, ours_name


def test_multiclass_matches_evaluator(spark):
    li = load_table(spark, SF_SMALL, "lineitem")
    mc = li.select((F.col("l_linenumber") - 1).cast("double").alias("label"),
                   (F.col("l_partkey") % 7).cast("double").alias("prediction"))
    assert abs(M.multiclass_scores(mc).first().f1 - MulticlassClassificationEvaluator(metricName="f1").evaluate(mc)) < 1e-12


def test_auroc_matches_evaluator_and_one_class_is_none(spark):
    p = _pred(spark)
    ev = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0).evaluate(p)
    assert abs(M.auroc_value(p, "score") - ev) < 1e-12
    assert M.auroc_value(p.where("label = 1"), "score") is None


def test_zero_denominator_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 0.0)], "label double, prediction double")
    s = M.scores_from_counts(M.confusion_counts(df)).first()
    assert (s.precision, s.recall, s.mcc) == (0.0, 0.0, 0.0)


def test_compat_confusion_one_class(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 0.0), (1.0, 1.0)], "label double, prediction double")
    r = M.confusion_counts_compat(df).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 0, 0, 2)
    plain = M.confusion_counts(df).first()
    assert (plain.tn, plain.fp, plain.fn, plain.tp) == (0, 0, 1, 2)


def test_param_grids(spark):
    dt = H.make_classifier("DT")
    rf = H.make_classifier("RF")
    g_dt, g_rf = H.param_grid(dt, "DT"), H.param_grid(rf, "RF")
    assert len(g_dt) == 30 and len(g_rf) == 9
    assert sorted({m[dt.maxDepth] for m in g_dt}) == [1, 6, 11, 16, 21, 26]
    assert sorted({m[dt.minInstancesPerNode] for m in g_dt}) == [1, 3, 5, 7, 9]
    assert sorted({m[rf.maxDepth] for m in g_rf}) == [15, 20, 25]
    assert sorted({m[rf.minInstancesPerNode] for m in g_rf}) == [5, 7, 9]
    assert rf.getNumTrees() == 100 and rf.getImpurity() == "entropy" and rf.getMaxBins() == 64


def test_separable_table_is_learned_and_roundtrips(spark, tmp_out):
    li = load_table(spark, SF_TINY, "lineitem")
    df = li.select(F.col("l_quantity").cast("string").alias("qty"),
                   F.when(F.col("l_quantity") > 25, "big").otherwise("small").alias("size"))
    chain, _ = H.chain_raw(df, "size", "DT")
    model = H.fit(chain, df)
    preds = H.predict(model, df)
    assert M.accuracy(preds).first()[0] >= 0.9
    assert preds.where(F.col("size") != F.col("predicted-size")).count() <= df.count() * 0.1
    path = save_classifier(model, tmp_out)
    again = load_classifier(path).transform(df)
    a = sorted((r.qty, r.prediction) for r in preds.collect())
    b = sorted((r.qty, r.prediction) for r in again.collect())
    assert a == b


def test_label_index_is_frequency_order(spark):
    c = X.classify(spark, SF_SMALL)
    _, idx = H.label_stages(c, "high_value")[0], H.label_stages(c, "high_value")[0]
    counts = dict(c.groupBy("high_value").count().collect())
    assert idx.labels[0] == max(counts, key=counts.get)


def test_two_stage_and_new_rows_batch_and_stream(spark, tmp_out):
    w = X.wide(spark, SF_TINY)
    seen, new = split_by_key(w, "id", 0.8)
    scores, summary, model = J.two_stage(seen, k=3, kind="DT")
    rows = scores.collect()
    assert sorted(r.cluster for r in rows) == list(range(len(rows)))
    assert sum(r.n_rows for r in rows) == seen.count()
    assert summary.first().k == 3
    batch = J.score_new(model, new)
    assert batch.count() == new.count()
    # streaming: the same chains over parquet files arriving in a folder
    from flawscope.streaming import start_scoring
    src, sink = tmp_out + "/in", tmp_out + "/out"
    new.write.parquet(src)
    q = start_scoring(spark, model, src, new.schema, sink, tmp_out + "/ckpt")
    q.awaitTermination(300)
    streamed = spark.read.parquet(sink)
    key = ["id", "cluster", "prediction"]
    assert sorted(streamed.select(*key).collect()) == sorted(batch.select(*key).collect())


def test_entry_contract(spark):
    import __spark_entry__ as E
    out = E.entry(spark)
    assert out.columns == ["cluster", "n_rows", "failure_rate"]
    assert out.agg(F.sum("n_rows")).first()[0] == X.wide(spark, SF_TINY).count()
    qs, oracles = E.queries(), E.oracle_sql()
    assert set(oracles) <= set(qs)
    assert len(qs) >= 80


def test_cv_best_params_in_grid_and_label_text(spark):
    prepared = J.prepare_classify_table(X.classify(spark, SF_TINY))
    chain, clf = H.chain_raw(prepared, "high_value", "DT")
    grid = H.param_grid(clf, "DT")
    model = H.fit(chain, prepared, grid, validate=True, folds=3, parallelism=3)
    best = H.best_params(model)
    assert best["maxDepth"] in {1, 6, 11, 16, 21, 26} and best["minInstancesPerNode"] in {1, 3, 5, 7, 9}
    labels = H.best_pipeline(model).stages[1].labels
    preds = H.predict(model, prepared).select("prediction", "predicted-high_value").collect()
    assert all(labels[int(r.prediction)] == r["predicted-high_value"] for r in preds)


def test_positive_label_pins_index_one(spark):
    df = spark.createDataFrame([("0",)] * 5 + [("1",)] * 2, "y string")
    freq, _ = H.label_stages(df, "y")
    pinned, back = H.label_stages(df, "y", positive_label="0")
    assert freq.labels == ["0", "1"]          # frequency order: the rarer label is index 1
    assert pinned.labels == ["1", "0"] and back.getLabels() == ["1", "0"]
    assert {r.y: r.label for r in pinned.transform(df).distinct().collect()} == {"1": 0.0, "0": 1.0}


def test_singleton_cluster_silhouette_is_zero_for_that_point(spark):
    from pyspark.ml.functions import array_to_vector
    from flawscope.operators import clustering as G
    rows = [([0.0], 0), ([0.1], 0), ([5.0], 1), ([5.1], 1), ([100.0], 2)]
    df = spark.createDataFrame(rows, "v array<double>, prediction int") \
        .select(array_to_vector("v").alias("features"), "prediction")
    s_all = G.silhouette_value(df)
    s_without = G.silhouette_value(df.where("prediction < 2"))
    # the singleton contributes 0, so the mean over 5 points is 4/5 of the others' mean (approx.)
    assert s_all is not None and s_all < s_without


def test_two_stage_with_a_constant_target_cluster(spark):
    w = X.wide(spark, SF_TINY)
    # keep one response value only for orders whose id bucket is low: some clusters become pure
    skewed = w.where((F.col("response") == 1) | key_below(F.col("id"), 0.1))
    scores, _, _ = J.two_stage(skewed, k=2, kind="DT")
    rows = scores.collect()
    assert sum(r.n_rows for r in rows) == skewed.count()
    assert all(r.accuracy is None or 0.0 <= r.accuracy <= 1.0 for r in rows)


def test_chain_vector_query_predicts_once(spark, monkeypatch):
    from flawscope.plans import queries_models as Q

    calls, predict = [], Q.H.predict
    monkeypatch.setattr(Q.H, "predict", lambda model, df: calls.append(1) or predict(model, df))
    got = Q.classifier_chain_vector_q(spark, "/root/testdata/sf0.001").collect()
    assert len(calls) == 1 and all(r["n_rows"] == r["n_consistent"] for r in got)


def test_totals_query_joins_its_table_together_once(spark, monkeypatch):
    """Fits and both scorings read the stored table, not the line items again."""
    from flawscope.plans import queries_models as Q

    read, score = [], Q.J.score_new
    monkeypatch.setattr(Q.J, "score_new", lambda model, df: read.extend(df.inputFiles()) or score(model, df))
    got = Q.two_stage_totals_q(spark, "/root/testdata/sf0.001").first()
    assert read and not any("lineitem" in f for f in read)
    assert got["n_different"] == 0 and got["n_rows"] == got["n_failures"] + got["n_others"]


def test_large_groups_are_not_kept_twice(spark):
    """A group of many partitions is kept by its fit alone, a small one is dealt and kept."""
    cores = spark.sparkContext.defaultParallelism
    large, kept = J._spread(spark.range(0, 100, 1, cores + 1), "id")
    assert not kept and not large.storageLevel.useMemory
    small, kept = J._spread(spark.range(0, 100, 1, 1), "id")
    assert kept and small.rdd.getNumPartitions() == cores
    small.unpersist()
