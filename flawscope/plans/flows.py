"""Composed flows.

* ``prepare_cluster_table`` / ``cluster_flow``      - J1 / J2 (arrests-like table)
* ``prepare_classify_table`` / ``classify_flow``    - J3 / J4 (census-like table)
* ``presence_pca`` / ``measure_pca``                - J6 / J7 (production-like wide table)
* ``two_stage``                                     - J8: cluster rows by their presence
  pattern, then fit one classifier per cluster
* ``score_new``                                     - J9: route new rows through the stored chains

Spark-first differences from the reference: the clustering step keeps the measurement columns
on every row (the PCA projection is a narrow transformation), so the per-cluster tables are
filters of one checkpointed table - no join back by id.  Every fitted step is kept in a
``PipelineModel`` so the chain can be stored and replayed on new rows (batch or stream).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flawscope.functions.columns import q
from flawscope.operators import classify as C
from flawscope.operators import clustering as G
from flawscope.operators import metrics as M
from flawscope.operators.clean import (drop_constant_columns, drop_null_rows, keep_columns,
                                       trim_values, values_to_null)
from flawscope.operators.features import assemble, binning, pca, quantile_bins, standardize
from flawscope.operators.sampling import drop_duplicates, split_by_key, train_test_split
from flawscope.session import materialize, scratch_dir
from flawscope.sources.models import (get_or_train, load_classifier, load_kmeans, path_exists,
                                      save_classifier, save_kmeans)
from flawscope.sources.tables import TableSpec

# Census-flow bins
AGE_SPLITS = (0, 18, 30, 60, 100)
HOURS_SPLITS = (0, 25, 40, 60, 100)


# ---------------------------------------------------------------- J1 / J2: clustering flow

def prepare_cluster_table(df: DataFrame, id_col: str = "city", features_col: str = "features"):
    """Assemble every column but the id, then standardise."""
    vec = assemble(df, features_col, [c for c in df.columns if c != id_col])
    return standardize(vec, features_col)


def cluster_flow(df: DataFrame, id_col: str = "city", max_k: int = 10, num_random: int = 30,
                 seed: int = 42, k: int | None = None, parallelism: int = 8, store: str | None = None):
    """J1 -> (gap search | fixed k | stored model) -> assign -> inertia, silhouette.

    With ``store`` a k-means model found there is used instead of a search, and a new one is put
    there.  Returns (assignments, summary one-row DataFrame, model, gap history rows)."""
    prepared, _ = prepare_cluster_table(df, id_col)
    prepared = prepared.persist(StorageLevel.MEMORY_AND_DISK)
    history = []

    def train():
        if k is not None:
            return G.kmeans_fit(prepared, k, seed=seed)
        _, model, found = G.find_num_clusters(prepared, "features", 2, max_k, num_random, seed,
                                              parallelism=parallelism)
        history.extend(found)
        return model

    try:
        model = get_or_train(df.sparkSession, store, load_kmeans, train, save_kmeans) if store else train()
        assigned = model.transform(prepared)
        inertia = G.inertia_value(assigned, G.centers_of(model))
        sil = G.silhouette_value(assigned)
    finally:
        prepared.unpersist()
    summary = df.sparkSession.createDataFrame([(len(G.centers_of(model)), inertia, sil)],
                                              "k int, inertia double, silhouette double")
    return assigned, summary, model, history


# ---------------------------------------------------------------- J3 / J4: classification flow

CLASSIFY_SPEC = TableSpec(
    name="classify",
    discrete=("age", "priority", "segment", "status", "nation", "hours"),
    continuous=("gain", "loss"),
    target=("high_value",),
)


def prepare_classify_table(df: DataFrame, spec: TableSpec = CLASSIFY_SPEC,
                           bins: Sequence[tuple[str, Sequence[float]]] = (("age", AGE_SPLITS),
                                                                         ("hours", HOURS_SPLITS)),
                           quantiles: Sequence[tuple[str, int]] = (("gain", 10), ("loss", 5)),
                           exact_quantiles: bool = True) -> DataFrame:
    """Trim -> keep useful -> '?'->null -> ''->null -> drop null rows -> dedup -> bins ->
    quantile bins (the reference's order, including dedup after the projection)."""
    out = trim_values(df)
    out = keep_columns(out, spec.useful)
    out = values_to_null(out, "?")
    out = values_to_null(out, "")
    out = drop_null_rows(out)
    out = drop_duplicates(out)
    for col, splits in bins:
        out, _ = binning(out, col, splits)
    if quantiles:  # the quantile searches scan it a few times: cut the deduplication's shuffle off
        out = materialize(out, "table")
    for col, n in quantiles:
        out, _ = quantile_bins(out, col, n, exact=exact_quantiles)
    return out


def classify_flow(df: DataFrame, spec: TableSpec = CLASSIFY_SPEC, kind: str = "DT",
                  validate: bool = False, settings: C.TreeSettings | None = None,
                  seed: int = 42, parallelism: int = 3, store: str | None = None):
    """J3 -> 80/20 split -> raw chain (CV optional, or the stored one) -> held-out test -> six
    metrics.  With ``store`` a classifier found there is used, and a new one is put there.

    The prepared table has no key, so the split is Spark's seeded one, over the stored table."""
    target = spec.target[0]
    prepared = materialize(prepare_classify_table(df, spec), "table")
    train, test = train_test_split(prepared, 0.8, seed)

    def fit():
        chain, clf = C.chain_raw(prepared, target, kind, settings=settings)
        grid = C.param_grid(clf, kind, settings) if validate else None
        return C.fit(chain, train, grid, validate, parallelism=parallelism, seed=seed, by_truncation=True)

    model = get_or_train(df.sparkSession, store, load_classifier, fit, save_classifier) if store else fit()
    preds = C.predict(model, test)
    return M.score_table(preds, score="rawPrediction"), model, preds


# ---------------------------------------------------------------- J5-J8: two-stage flow

def common_prepare(df: DataFrame, id_col: str = "id", target: str = "response",
                   approx: bool = False) -> DataFrame:
    """Drop constant columns (id and target protected)."""
    return drop_constant_columns(df, approx=approx, exclude=[id_col, target])


def presence_flags(df: DataFrame, id_col: str = "id", target: str = "response",
                   carry: Sequence[str] = ()) -> DataFrame:
    """B10 for the clustering step: ``_p_<c>`` = 1 when measurement c is present."""
    measures = [c for c in df.columns if c not in (id_col, target)]
    return df.select(*[q(c) for c in [id_col, target, *carry]],
                     *[F.when(q(c).isNull(), 0).otherwise(1).alias(f"_p_{c}") for c in measures])


def presence_pca(df: DataFrame, id_col: str = "id", target: str = "response",
                 max_components: int = 50, explained: float = 0.95, carry: Sequence[str] = ()):
    """Presence map -> PCA (not standardised, <= 50 comps, 95 %); keeps id, target and
    any ``carry`` columns (as their original values)."""
    flags = presence_flags(df, id_col, target, carry)
    return pca(flags, max_components, assemble_features=True, standardize_features=False,
               explained_variance=explained, exclude=[id_col, target, *carry])


def measure_pca(df: DataFrame, id_col: str = "id", target: str = "response",
                max_components: int = 50, explained: float = 0.95):
    """Drop constants -> mean imputation -> PCA (standardised).  Returns
    (table, loadings, replay chain, number of components); a table in which no column varies has
    no features and raises."""
    stats = group_stats(df.withColumn("_g", F.lit(0)), "_g", [c for c in df.columns if c not in (id_col, target)])
    out, pc, chain, n = _reduce(df, id_col, target, stats.get(0, {}), max_components, explained)
    return out, pc, chain, n


def group_stats(df: DataFrame, group: str, columns: Sequence[str]) -> dict:
    """Per group, the mean of every column that varies in it (null, NaN and infinite values are missing).

    All groups and columns in one aggregate over (group, column, value) rows, so the plan does
    not grow with the width; one row per group and varying column reaches the driver."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast("double").alias("v"))
                                for i, c in enumerate(columns)]))
    rows = (df.select(q(group).alias("g"), cells.alias("x")).select("g", "x.*")
            .where("abs(v) < double('Infinity')").groupBy("g", "c")
            .agg(F.avg("v").alias("mean"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            .where("lo < hi").select("g", "c", "mean").collect()) if columns else []
    out: dict = {}
    for r in sorted(rows, key=lambda r: r["c"]):
        out.setdefault(r["g"], {})[columns[r["c"]]] = r["mean"]
    return out


def _spread(df: DataFrame, key: str) -> tuple[DataFrame, bool]:
    """A small group's few files dealt over all cores and kept; a large group has partitions enough and is read again,
    as its fit keeps the label and features (``tree_fit``).  Also whether it is kept."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df, False
    return df.repartition(cores, q(key)).persist(StorageLevel.MEMORY_AND_DISK), True


def _reduce(df: DataFrame, id_col: str, target: str, means: dict[str, float], max_components: int,
            explained: float):
    """The varying columns, imputed with their means, reduced by PCA; and the chain that replays it."""
    if not means:
        raise ValueError("no measurement varies")
    name = lambda c: "`" + c.replace("`", "``") + "`"
    fill = SQLTransformer(statement="SELECT " + ", ".join(
        [name(id_col), name(target)] + [f"if(abs(CAST({name(c)} AS DOUBLE)) < double('Infinity'), CAST({name(c)} AS DOUBLE), {m!r}D)"
                                        f" AS {name(c)}" for c, m in means.items()]) + " FROM __THIS__")
    out, pc, stages = pca(fill.transform(df), max_components, assemble_features=True,
                          standardize_features=True, explained_variance=explained,
                          exclude=[id_col, target])
    return out, pc, PipelineModel(stages=[fill, *stages["chain"].stages]), stages["n_components"]


@dataclass
class TwoStageModel:
    """Everything needed to score new rows: columns kept, clustering chain, and per group a
    (measure chain, classifier) pair, or the label of its majority where nothing can be learned."""

    id_col: str
    target: str
    measures: list[str]
    cluster_chain: PipelineModel
    kmeans: object
    per_cluster: dict = field(default_factory=dict)
    majority: dict = field(default_factory=dict)  # group -> (index, label text)
    validated: dict = field(default_factory=dict)  # group -> (depth, leaf size, mean fold accuracy), of this fit

    def save(self, path: str) -> str:
        """Store the model below ``path`` (any Hadoop file system)."""
        spark = SparkSession.getActiveSession()
        self.cluster_chain.write().overwrite().save(f"{path}/cluster_chain")
        save_kmeans(self.kmeans, f"{path}/kmeans")
        for c, (chain, clf) in self.per_cluster.items():
            chain.write().overwrite().save(f"{path}/group={c}/measures")
            clf.write().overwrite().save(f"{path}/group={c}/classifier")
        about = {"id_col": self.id_col, "target": self.target, "measures": self.measures,
                 "groups": sorted(self.per_cluster), "majority": sorted(self.majority.items())}
        # written last: a model without it is not complete
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite") \
            .text(f"{path}/about")
        return path

    @staticmethod
    def load(path: str) -> TwoStageModel:
        about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about").first()[0])
        return TwoStageModel(
            about["id_col"], about["target"], about["measures"], PipelineModel.load(f"{path}/cluster_chain"),
            load_kmeans(f"{path}/kmeans"),
            {c: (PipelineModel.load(f"{path}/group={c}/measures"), load_classifier(f"{path}/group={c}/classifier"))
             for c in about["groups"]}, {c: tuple(v) for c, v in about["majority"]})


def two_stage(df: DataFrame, id_col: str = "id", target: str = "response", k: int = 6,
              kind: str = "RF", validate: bool = False, settings: C.TreeSettings | None = None,
              max_components: int = 50, explained: float = 0.95, seed: int = 42,
              cluster_parallelism: int = 3, cv_parallelism: int = 3,
              positive_label: str | None = None, store: str | None = None, written: bool = False):
    """J5 -> J6 -> k-means(k) -> inertia / silhouette -> per group: J7 -> fit -> test ->
    scores.  Returns (per-group score table, clustering summary, TwoStageModel).

    The grouped table is written once, by group, so each group's passes read its own folder.
    Statistics of all groups are one aggregate, scores of all groups one plan.  Rows are split by
    the hash of their id.  A group in which no measurement or no label varies is given its
    majority label; a group without test rows has null scores.  ``validate`` cross-validates each
    group's grid, trees and forests by cutting back deep ones (``operators.tree_grid``); the winners
    are in the model's ``validated``.  With ``store`` a model found
    there is used for k-means, reduction and classifiers; a new one is put there.
    ``written``: ``df`` is a stored table, which is read as it is; else it is written once first.
    """
    spark = df.sparkSession
    stored = TwoStageModel.load(store) if store and path_exists(spark, f"{store}/about/_SUCCESS") else None
    df = df if written else materialize(df, "table")
    if stored:
        model, measures = stored, stored.measures
        with_features = _grouped(model, df, keep=[target])
    else:
        common = common_prepare(df, id_col, target)
        measures = [c for c in common.columns if c not in (id_col, target)]
        reduced, _, pstages = presence_pca(common, id_col, target, max_components, explained, carry=measures)
        model = TwoStageModel(id_col, target, measures, pstages["chain"], G.kmeans_fit(reduced, k, seed=seed))
        with_features = model.kmeans.transform(reduced).withColumnRenamed("prediction", "cluster")
    path = scratch_dir(spark, "groups")
    with_features = with_features.select(id_col, target, "cluster", "features", *[q(c) for c in measures])
    with_features.write.partitionBy("cluster").parquet(path)
    assigned = spark.read.schema(with_features.schema).parquet(path)
    inertia = G.inertia_value(assigned, G.centers_of(model.kmeans))
    sil = G.silhouette_value(assigned, "features", "cluster")
    label = q(target).cast("string")
    # rows per group and label: k x labels rows
    counts: dict = {}
    for r in assigned.groupBy("cluster", label.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault(r["cluster"], {})[r["y"]] = r["n"]
    clusters = sorted(counts)
    means = group_stats(assigned, "cluster", measures) if not stored else {}

    def reduced_rows(c, chain):
        part = assigned.where(F.col("cluster") == c).select(id_col, label.alias(target), *[q(m) for m in measures])
        return chain.transform(part).select(q(id_col), q(target), F.col("_proj").alias("features"))

    def per_cluster(c):
        part = assigned.where(F.col("cluster") == c).select(id_col, label.alias(target), *[q(m) for m in measures])
        known = {y: n for y, n in counts[c].items() if y is not None}
        if c not in means or len(known) < 2:
            top = min(known, key=lambda y: (-known[y], y)) if known else None
            model.majority[c] = (0.0, top)
            return
        _, _, chain, _ = _reduce(part, id_col, target, means[c], max_components, explained)
        table, kept = _spread(reduced_rows(c, chain).where(q(target).isNotNull()), id_col)
        try:
            pipe, clf = C.chain_vector(table, target, kind, settings=settings, positive_label=positive_label)
            train, _ = split_by_key(table, id_col, 0.8)
            if train.isEmpty():
                train = table
            grid = C.param_grid(clf, kind, settings) if validate else None
            fitted = C.fit(pipe, train, grid, validate, parallelism=cv_parallelism, seed=seed, by_truncation=True)
        finally:
            if kept:
                table.unpersist()
        model.per_cluster[c] = (chain, C.best_pipeline(fitted))
        if validate:
            model.validated[c] = (*C.best_params(fitted).values(), float(max(fitted.avgMetrics)))

    if not stored:
        with ThreadPoolExecutor(max_workers=cluster_parallelism) as pool:
            list(pool.map(per_cluster, clusters))
        if store:
            model.save(store)

    tested = []
    for c in clusters:
        if c in model.per_cluster:
            chain, clf = model.per_cluster[c]
            _, test = split_by_key(reduced_rows(c, chain).where(q(target).isNotNull()), id_col, 0.8)
            scored = clf.transform(test).select(
                F.lit(c).alias("cluster"), "label", "prediction",
                F.element_at(vector_to_array("rawPrediction"), -1).alias("score"))
        else:
            _, test = split_by_key(assigned.where((F.col("cluster") == c) & q(target).isNotNull()), id_col, 0.8)
            wrong = label != F.lit(model.majority.get(c, (0.0, None))[1])
            scored = test.select(F.lit(c).alias("cluster"), F.coalesce(wrong, F.lit(True)).cast("double").alias("label"),
                                 F.lit(0.0).alias("prediction"), F.lit(0.0).alias("score"))
        tested.append(scored)
    preds = reduce(DataFrame.unionByName, tested).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        got = {r["cluster"]: r.asDict() for r in M.score_table(preds, score="score", by="cluster").collect()}
    finally:
        preds.unpersist()
    names = ("accuracy", "precision", "recall", "f1", "auroc", "mcc")
    positive = positive_label or "1"
    rows = []
    for c in clusters:
        n, sc = sum(counts[c].values()), got.get(c, {})
        fails = counts[c].get(positive, 0)
        ncomp = len(model.per_cluster[c][0].stages[-1].getIndices()) if c in model.per_cluster else 0
        rows.append((int(c), n, fails, n - fails, fails / n, ncomp, *(sc.get(x) for x in names)))
    scores = spark.createDataFrame(
        rows, "cluster int, n_rows long, n_failures long, n_others long, failure_rate double, "
              "n_components int, accuracy double, precision double, recall double, f1 double, auroc double, "
              "mcc double")
    total, fails = sum(r[1] for r in rows), sum(r[2] for r in rows)
    summary = spark.createDataFrame(
        [(len(G.centers_of(model.kmeans)), inertia, sil, total, fails, total - fails)],
        "k int, inertia double, silhouette double, n_rows long, n_failures long, n_others long")
    return scores, summary, model


def cluster_summary(df: DataFrame, id_col: str = "id", target: str = "response", k: int = 6,
                    max_components: int = 50, explained: float = 0.95, seed: int = 42) -> DataFrame:
    """Entry slice: J5 -> J6 -> k-means(k) -> rows and failure rate per cluster."""
    common = common_prepare(materialize(df, "table"), id_col, target)
    reduced, _, _ = presence_pca(common, id_col, target, max_components, explained)
    km = G.kmeans_fit(reduced, k, seed=seed)
    return (km.transform(reduced).groupBy(F.col("prediction").alias("cluster"))
              .agg(F.count(F.lit(1)).alias("n_rows"),
                   F.avg(q(target).cast("double")).alias("failure_rate")))


def _grouped(model: TwoStageModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows with the features and the group that the stored clustering chain gives them."""
    cols = [model.id_col, *keep, *model.measures]
    flags = df.select(*[q(c) for c in cols],
                      *[F.when(q(c).isNull(), 0).otherwise(1).alias(f"_p_{c}") for c in model.measures])
    reduced = model.cluster_chain.transform(flags)
    routed = model.kmeans.transform(reduced.select(*[q(c) for c in cols], F.col("_proj").alias("features")))
    return routed.withColumnRenamed("prediction", "cluster")


def route_new(model: TwoStageModel, df: DataFrame) -> DataFrame:
    """J9, first half: the stored clustering chain gives every new row its cluster."""
    return _grouped(model, df).select(q(model.id_col), *[q(c) for c in model.measures], "cluster")


def score_routed(model: TwoStageModel, routed: DataFrame) -> DataFrame:
    """J9, second half: each cluster's stored measure chain and classifier on its rows.

    Every row comes back: groups without a classifier get their majority label, rows of a group
    the model does not know a null prediction."""
    result = ("cluster", "prediction", "predicted")
    outs = []
    for c, (chain, clf) in sorted(model.per_cluster.items()):
        part = routed.where(F.col("cluster") == c).withColumn(model.target, F.lit("0"))
        prepared = chain.transform(part).select(model.id_col, model.target,
                                                F.col("_proj").alias("features"))
        scored = clf.transform(prepared)
        outs.append(scored.select(model.id_col, F.lit(c).alias("cluster"), "prediction",
                                  F.col(f"predicted-{model.target}").alias("predicted")))
    plain = routed.where(~F.coalesce(F.col("cluster").isin(list(model.per_cluster)), F.lit(False))) \
        if model.per_cluster else routed
    index, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    for c, (i, t) in model.majority.items():
        here = F.col("cluster") == c
        index, text = F.when(here, F.lit(i)).otherwise(index), F.when(here, F.lit(t)).otherwise(text)
    outs.append(plain.select(model.id_col, "cluster", index.alias(result[1]), text.alias(result[2])))
    return reduce(DataFrame.unionByName, outs)


def score_new(model: TwoStageModel, df: DataFrame) -> DataFrame:
    """Route new rows by cluster, then score each cluster's rows with its stored chain; one
    union of the per-cluster results.  All branches read the routed rows, so those are written
    once, by group; a streaming input is scored per micro-batch in ``streaming``."""
    path = scratch_dir(df.sparkSession, "routed")
    routed = route_new(model, df)
    routed.write.partitionBy("cluster").parquet(path)
    # the schema is given: a table without rows has no file to tell it
    return score_routed(model, df.sparkSession.read.schema(routed.schema).parquet(path).select(*routed.columns))
