"""Fits on distinct rows with their number are fits on all rows; small tables run on all cores."""

import pytest

from flawscope.operators import classify as C
from flawscope.operators import tree_fit as T


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(0, 4000, 1, 1).selectExpr(
        "cast(pmod(hash(id, 1), 5) as string) a", "cast(pmod(hash(id, 2), 70) as string) b",
        "cast(pmod(hash(id, 3), 3) as string) c",
        "if(pmod(hash(id, 1), 5) + pmod(hash(id, 2), 7) + pmod(hash(id, 4), 4) > 6, 'x', 'y') y").coalesce(1)


@pytest.mark.parametrize("kind", ["DT", "GBT"])
@pytest.mark.parametrize("leaf", [1, 10])
def test_counted_rows_give_the_same_trees(spark, rows, kind, leaf):
    settings = C.TreeSettings(max_depth=8, min_leaf=leaf, cache_node_ids=False)
    chain, clf = C.chain_raw(rows, "y", kind, settings=settings)
    if kind == "GBT":
        clf.setMaxIter(2)
    plain, counted = chain.fit(rows), T.fit_chain(chain, rows)
    one, two = plain.stages[-2], counted.stages[-2]
    assert one.numClasses == two.numClasses
    if kind == "DT":  # boosted trees learn from sums of fractions, which round by their order
        assert one.toDebugString.split("\n")[1:] == two.toDebugString.split("\n")[1:]
    assert C.best_params(plain) == C.best_params(counted)
    a, b = (m.transform(rows).select("prediction").collect() for m in (plain, counted))
    assert a == b


def test_single_chain_runs_on_few_rows(spark, rows, monkeypatch):
    """The classifier gets the distinct rows, on all cores (before: every row, in the table's one partition)."""
    seen = []
    fit = T.fit_counted
    monkeypatch.setattr(T, "fit_counted", lambda clf, df: seen.append(df) or fit(clf, df))
    chain, _ = C.chain_raw(rows, "y", "DT", settings=C.TreeSettings(max_depth=3))
    C.fit(chain, rows)
    assert seen[0].rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert seen[0].count() == rows.distinct().count() < rows.count()


@pytest.mark.parametrize("n", [3, 15, 25, 64, 100])
def test_few_rows(spark, n):
    df = spark.range(n).selectExpr("cast(id % 3 as string) a", "cast(id % 2 as string) b", "if(id % 3 = 0, 'x', 'y') y")
    chain, _ = C.chain_raw(df, "y", "DT", settings=C.TreeSettings(max_depth=4, min_leaf=5))
    a, b = (m.stages[-2].toDebugString.split("\n")[1:] for m in (chain.fit(df), C.fit(chain, df)))
    assert a == b


def test_numbers_and_forests_get_all_rows(spark, rows):
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler

    plain = VectorAssembler(inputCols=["v"], outputCol="features").transform(rows.selectExpr("cast(a as double) v", "0D label"))
    assert not T.can_weigh(C.make_classifier("DT"), plain)
    chain, clf = C.chain_raw(rows, "y", "RF")
    assert not T.can_weigh(clf, PipelineModel(stages=chain.getStages()[:3]).transform(rows))


def test_boosted_trees_cut_their_lineage_after_each_tree():
    clf = C.make_classifier("GBT")
    assert clf.getCheckpointInterval() == 1 and not clf.getCacheNodeIds()


def test_many_partitions_are_put_together(spark):
    """Every partition sends the statistics of all open nodes, so there are no more than cores (16 files go to one at most)."""
    cores = spark.sparkContext.defaultParallelism
    many = spark.range(0, 1000, 1, 5 * cores).selectExpr("id", "id % 7 as x")
    few = T.spread(many)
    assert few.rdd.getNumPartitions() == cores
    assert few.agg({"id": "sum"}).first() == many.agg({"id": "sum"}).first() and few.count() == 1000
    assert T.spread(spark.range(0, 1000, 1, 40 * cores)).rdd.getNumPartitions() <= 3 * cores
    assert T.spread(spark.range(0, 10, 1, 1)).rdd.getNumPartitions() == cores
