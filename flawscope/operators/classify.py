"""Classification (H1-H8): tree classifiers, label/feature chains, grids, cross-validation.

Every fit is a distributed Spark ML job.  ``CrossValidator`` runs grid points concurrently
(``parallelism``), each of them distributed over the cluster.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame

from flawscope.operators.features import check_categories
from flawscope.operators.forest_fit import size_mb as _size_mb
from flawscope.operators.tree_fit import fit_chain
from flawscope.operators.tree_grid import can_cut_back, grid_by_truncation


@dataclass(frozen=True)
class TreeSettings:
    """Fixed values of the reference's classifiers."""

    impurity: str = "entropy"
    max_depth: int = 30
    max_bins: int = 64
    min_leaf: int = 10
    num_trees: int = 100
    seed: int = 42
    # execution only (the learned trees do not change): bigger node groups per pass over the
    # data (None = derived from executor memory per core), node ids cached next to the rows
    # instead of shipping trees to every task, node-id lineage cut every 10 levels
    max_memory_mb: int | None = None
    cache_node_ids: bool = True
    checkpoint_interval: int = 10


# Defaults per classifier kind.  Boosted trees: the tasks of every level carry all that came before since the
# last checkpoint (trees, node ids), so that is written after each tree and node ids are not kept
DEFAULTS = {
    "DT": TreeSettings(max_depth=30),
    "RF": TreeSettings(max_depth=25, num_trees=100),
    "GBT": TreeSettings(max_depth=30, cache_node_ids=False, checkpoint_interval=1),
}


def tree_memory_mb(spark=None) -> int:
    """Node-statistics buffer per task: half the heap share of one core, 256-2048 MB.

    Every concurrently running task may hold one such buffer, so it must follow the
    executor size (local mode: the driver heap shared by all cores)."""
    from pyspark.sql import SparkSession

    spark = spark or SparkSession.getActiveSession()
    if spark is None:
        return 256
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local")
    heap = _size_mb(conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g"))
    cores = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return max(256, min(2048, heap // (2 * max(1, cores))))


def make_classifier(kind: str = "DT", label_col: str = "label", features_col: str = "features",
                    prediction_col: str = "prediction", settings: TreeSettings | None = None,
                    max_bins: int | None = None):
    """H1-H3: decision tree, random forest (100 trees) or gradient-boosted trees."""
    kind = kind.upper()
    s = settings or DEFAULTS[kind]
    common = dict(labelCol=label_col, featuresCol=features_col, predictionCol=prediction_col,
                  maxDepth=s.max_depth, maxBins=max_bins or s.max_bins,
                  minInstancesPerNode=s.min_leaf, seed=s.seed,
                  maxMemoryInMB=s.max_memory_mb or tree_memory_mb(),
                  cacheNodeIds=s.cache_node_ids, checkpointInterval=s.checkpoint_interval)
    if kind == "DT":
        return DecisionTreeClassifier(impurity=s.impurity, **common)
    if kind == "RF":
        return RandomForestClassifier(impurity=s.impurity, numTrees=s.num_trees, **common)
    if kind == "GBT":
        return GBTClassifier(**common)
    raise ValueError(f"unsupported classifier {kind}")


def param_grid(estimator, kind: str, settings: TreeSettings | None = None):
    """H6: DT / GBT depth {1,6,...} x leaf {1,3,...}; RF depth {15,20,25} x leaf {5,7,9}."""
    kind = kind.upper()
    s = settings or DEFAULTS[kind]
    if kind == "RF":
        depths, leaves = range(15, s.max_depth + 1, 5), range(5, s.min_leaf + 1, 2)
    else:
        depths, leaves = range(1, s.max_depth + 1, 5), range(1, s.min_leaf + 1, 2)
    return (ParamGridBuilder().addGrid(estimator.maxDepth, list(depths))
            .addGrid(estimator.minInstancesPerNode, list(leaves)).build())


def label_stages(df: DataFrame, target: str, label_col: str = "label",
                 prediction_col: str = "prediction", positive_label: str | None = None):
    """Label indexer fitted on the table given, and its inverse for ``predicted-<target>``.

    Default: frequency order, like the reference - index 1 ("positive" for precision, recall,
    AUROC) is then the rarer label of *this* table, which flips between clusters.
    ``positive_label`` pins that label to index 1 (binary targets), whatever the counts.
    """
    indexer = StringIndexer(inputCol=target, outputCol=label_col).fit(df)
    if positive_label is not None:
        labels = [v for v in indexer.labels if v != str(positive_label)]
        labels.insert(min(1, len(labels)), str(positive_label))
        indexer = StringIndexerModel.from_labels(labels, inputCol=target, outputCol=label_col)
    back = IndexToString(inputCol=prediction_col, outputCol=f"predicted-{target}",
                         labels=indexer.labels)
    return indexer, back


def chain_raw(df: DataFrame, target: str, kind: str = "DT", features_col: str = "features",
              settings: TreeSettings | None = None, positive_label: str | None = None,
              max_categories: int = 10_000) -> tuple[Pipeline, object]:
    """H4: index every feature (as categories) -> index label -> assemble -> tree -> label text.

    Indexers are fitted on the whole table, like the reference.  ``maxBins`` is raised to the
    largest number of categories, since every indexed feature is marked categorical; tables
    with a column of more than ``max_categories`` distinct values are refused.
    """
    cols = [c for c in df.columns if c != target]
    check_categories(df, cols, max_categories)
    feat_idx = StringIndexer(inputCols=cols, outputCols=[f"indexed-{c}" for c in cols]).fit(df)
    lab_idx, back = label_stages(df, target, positive_label=positive_label)
    s = settings or DEFAULTS[kind.upper()]
    # every indexed feature is categorical: maxBins >= its number of labels (known from the fit)
    bins = max([s.max_bins, *[len(labels) for labels in feat_idx.labelsArray]])
    asm = VectorAssembler(inputCols=feat_idx.getOutputCols(), outputCol=features_col)
    clf = make_classifier(kind, features_col=features_col, settings=s, max_bins=bins)
    return Pipeline(stages=[feat_idx, lab_idx, asm, clf, back]), clf


def chain_vector(df: DataFrame, target: str, kind: str = "DT", features_col: str = "features",
                 settings: TreeSettings | None = None,
                 positive_label: str | None = None) -> tuple[Pipeline, object]:
    """H5: features already a vector: index label -> tree -> label text."""
    lab_idx, back = label_stages(df, target, positive_label=positive_label)
    clf = make_classifier(kind, features_col=features_col, settings=settings)
    return Pipeline(stages=[lab_idx, clf, back]), clf


def evaluator(metric: str = "accuracy") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol="label", predictionCol="prediction",
                                             metricName=metric)


def fit(chain: Pipeline, train: DataFrame, grid=None, validate: bool = False, folds: int = 3,
        parallelism: int = 3, seed: int = 42, metric: str = "accuracy", by_truncation: bool = False):
    """H7: a single fit, or k-fold cross-validation over ``grid`` (best model refitted).  With ``by_truncation``
    the depths of a tree's or forest's grid are read off one fit per fold and leaf size (``tree_grid``)."""
    if not validate:
        return fit_chain(chain, train)
    if by_truncation and metric == "accuracy" and can_cut_back(chain):
        return grid_by_truncation(chain, train, grid, folds, seed, parallelism=parallelism)
    cv = CrossValidator(estimator=chain, estimatorParamMaps=grid, evaluator=evaluator(metric),
                        numFolds=folds, parallelism=parallelism, seed=seed)
    return cv.fit(train)


def best_pipeline(model) -> PipelineModel:
    return model.bestModel if hasattr(model, "bestModel") else model


def best_params(model, keys: Sequence[str] = ("maxDepth", "minInstancesPerNode")) -> dict:
    """The grid point CV chose (read from the fitted tree stage)."""
    stage = best_pipeline(model).stages[-2]
    stage = getattr(stage, "settings", stage)  # of a forest in parts
    return {k: stage.getOrDefault(stage.getParam(k)) for k in keys}


def predict(model, df: DataFrame) -> DataFrame:
    """H8: a chain's predictions; of a cross-validated one, those of the best chain."""
    return best_pipeline(model).transform(df)
