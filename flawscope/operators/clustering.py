"""Clustering (G1-G12): k-means, inertia, silhouette, gap statistic, choice of k.

The k centres (k x d doubles, small by construction) travel as literals inside the plan, so
inertia / nearest-centre are plain expressions over them - no broadcast variable, no RDD.  Reference draws for the gap statistic are generated on the executors from the rows
of the data itself (same partitioning, same size), seeded per draw, and reused over all k.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flawscope.functions.columns import double_matrix, nearest, nearest_of_few, q
from flawscope.operators.batched_kmeans import batched_kmeans, in_blocks
from flawscope.operators.features import vector_size
from flawscope.session import materialize


PLAIN_TERMS = 500  # numbers of all centres


def kmeans_fit(df: DataFrame, k: int, features_col: str = "features",
               prediction_col: str = "prediction", seed: int = 42, max_iter: int = 20,
               tol: float = 1e-4, init_mode: str = "k-means||") -> KMeansModel:
    """G1: Euclidean k-means (Spark defaults: k-means||, 20 iterations, tol 1e-4)."""
    km = KMeans(k=k, seed=seed, maxIter=max_iter, tol=tol, initMode=init_mode,
                distanceMeasure="euclidean", featuresCol=features_col,
                predictionCol=prediction_col)
    return km.fit(df)


def assign(model: KMeansModel, df: DataFrame) -> DataFrame:
    """G2."""
    return model.transform(df)


def centers_of(model: KMeansModel) -> list[list[float]]:
    return [list(map(float, c)) for c in model.clusterCenters()]


def cluster_centers(model: KMeansModel, spark) -> DataFrame:
    """(cluster, center) rows."""
    return spark.createDataFrame([(i, c) for i, c in enumerate(centers_of(model))],
                                 "cluster int, center array<double>")


def nearest_center(df: DataFrame, centers: Sequence[Sequence[float]], features_col: str = "features",
                   keep: Sequence[str] = (), is_vector: bool = True) -> DataFrame:
    """Index of the nearest centre (first wins ties) and its squared distance.

    Up to ``PLAIN_TERMS`` numbers the centres are plain sums, which Spark compiles; larger ones are one literal,
    so that the plan has the same few expressions for any k and d."""
    x = vector_to_array(q(features_col)) if is_vector else q(features_col).cast("array<double>")
    if sum(map(len, centers)) <= PLAIN_TERMS:
        best = nearest_of_few(x, centers)
    else:
        best = nearest(x, double_matrix(centers))
    return (df.select(*[q(c) for c in keep], best.alias("_best"))
              .select(*[q(c) for c in keep], F.col("_best.nearest").alias("nearest"),
                      F.col("_best.cost").alias("cost")))


def inertia(df: DataFrame, centers: Sequence[Sequence[float]], features_col: str = "features",
            is_vector: bool = True) -> DataFrame:
    """Sum over rows of the squared distance to the nearest centre (one aggregate)."""
    return nearest_center(df, centers, features_col, is_vector=is_vector).agg(
        F.sum("cost").alias("inertia"))


def inertia_value(df: DataFrame, centers, features_col: str = "features") -> float:
    v = inertia(df, centers, features_col).first()[0]
    return float(v) if v is not None else 0.0


def silhouette_value(df: DataFrame, features_col: str = "features",
                     prediction_col: str = "prediction") -> float | None:
    """Mean silhouette (squared Euclidean); None for a single cluster instead of raising."""
    if df.select(prediction_col).distinct().limit(2).count() < 2:
        return None
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol=prediction_col,
                             metricName="silhouette", distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(df))


def feature_ranges(df: DataFrame, features_col: str = "features") -> list[tuple[float, float]]:
    """Per-feature (min, max) of a vector column, one aggregate (the only driver data: 2 x d)."""
    d = vector_size(df, features_col)
    arr = vector_to_array(q(features_col))
    exprs = []
    for i in range(d):
        exprs += [F.min(arr.getItem(i)), F.max(arr.getItem(i))]
    row = df.agg(*exprs).first()
    return [(float(row[2 * i]), float(row[2 * i + 1])) for i in range(d)]


def reference_uniform(df: DataFrame, ranges: Sequence[tuple[float, float]], seed: int,
                      features_col: str = "features") -> DataFrame:
    """One uniform row inside the feature box for every row of ``df`` (same partitions)."""
    cols = [F.rand(seed * 1000 + i) * F.lit(b - a) + F.lit(a) for i, (a, b) in enumerate(ranges)]
    return df.select(array_to_vector(F.array(*cols)).alias(features_col))


def reference_tables(df: DataFrame, ranges: Sequence[tuple[float, float]], num_random: int, seed: int) -> DataFrame:
    """G7 for the gap search: ``num_random`` uniform tables of as many rows as ``df``, written once, in blocks."""
    box = [F.rand(seed * 1000 + i) * F.lit(b - a) + F.lit(a) for i, (a, b) in enumerate(ranges)]
    draws = df.select(F.explode(F.sequence(F.lit(0), F.lit(num_random - 1))).alias("draw"))
    return materialize(in_blocks(draws.select("draw", F.array(*box).alias("x"))), "table")


def log_inertia_of_fit(df: DataFrame, k: int, seed: int, features_col: str = "features") -> float:
    """Log of the inertia of a k-means fitted on ``df`` (against its final centres)."""
    model = kmeans_fit(df, k, features_col, seed=seed)
    return _log(inertia_value(df, centers_of(model), features_col))


def _log(inertia: float) -> float:
    """Log inertia; every point on its centre (inertia 0) is minus infinity."""
    return math.log(inertia) if inertia > 0 else -math.inf


def gap_deviation(std_dev: float, num_random: int) -> float:
    """s = sd * sqrt(1 + 1/B)."""
    return std_dev * math.sqrt(1.0 + 1.0 / num_random)


def gap_table(log_w: DataFrame, log_w_ref: DataFrame) -> DataFrame:
    """G9/G10 in table form: ``log_w(k, log_w)`` and ``log_w_ref(k, b, log_w)`` ->
    ``(k, gap, s)`` with gap = mean_b(log_w_ref) - log_w and s = sd_pop * sqrt(1 + 1/B)."""
    ref = log_w_ref.groupBy("k").agg(F.avg("log_w").alias("e_log_w"),
                                     F.stddev_pop("log_w").alias("sd"),
                                     F.count(F.lit(1)).alias("b"))
    return (ref.join(log_w.select("k", F.col("log_w").alias("obs")), "k")
               .select("k", (F.col("e_log_w") - F.col("obs")).alias("gap"),
                       (F.col("sd") * F.sqrt(1 + 1 / F.col("b"))).alias("s")))


def choose_k(gaps: DataFrame, strict: bool = True) -> DataFrame:
    """The smallest k with gap(k) > gap(k+1) - s(k+1) (``>=`` when not strict); the
    largest k when none qualifies.  ``gaps`` is a small (k, gap, s) table."""
    w = Window.orderBy("k")
    nxt_gap, nxt_s = F.lead("gap").over(w), F.lead("s").over(w)
    hit = (F.col("gap") > nxt_gap - nxt_s) if strict else (F.col("gap") >= nxt_gap - nxt_s)
    flagged = gaps.select("k", F.coalesce(hit, F.lit(False)).alias("stop"))
    return flagged.agg(F.coalesce(F.min(F.when(F.col("stop"), F.col("k"))), F.max("k"))
                       .alias("chosen_k"))


def find_num_clusters(df: DataFrame, features_col: str = "features", min_k: int = 2,
                      max_k: int | None = None, num_random: int = 30, seed: int = 42,
                      strict: bool = True, parallelism: int = 8, batched: bool = True):
    """J2's search: fit k = min_k, min_k+1, ...; stop at the first k whose gap fails to beat
    the previous one (reference rule).  Returns (k, model, rows of (k, gap, s, log_w)).

    The B reference draws are made and written once and used for every k.  All of them are fitted in the same
    jobs (``batched_kmeans``), so a k costs as many jobs for 30 draws as for one.  With
    ``batched=False`` each draw is a k-means job of its own, made anew when read, up to ``parallelism`` at once: Spark's
    k-means keeps a copy of its input while it runs, so at most as many draws run at once as fit half of the
    executors' storage memory.  An inertia of 0 (k centres on k distinct points) ends the search with that k.
    """
    n = df.count()
    max_k = min(max_k or n, n)
    ranges = feature_ranges(df, features_col)
    history = []
    if batched:
        tables = reference_tables(df, ranges, num_random, seed)

        def reference_fits(k):
            return [_log(w) for _, (_, w) in sorted(batched_kmeans(tables, k, seed).items())]
    else:
        draws = [reference_uniform(df, ranges, seed + b + 1, features_col) for b in range(num_random)]
        at_once = max(1, min(parallelism, int(_storage_bytes(df.sparkSession) / 2
                                              / max(1, n * (8 * len(ranges) + 48)))))

        def reference_fits(k):
            with ThreadPoolExecutor(max_workers=at_once) as pool:
                return list(pool.map(lambda dr: log_inertia_of_fit(dr, k, seed, features_col), draws))

    def gap_at(k):
        model = kmeans_fit(df, k, features_col, seed=seed)
        lw = _log(inertia_value(df, centers_of(model), features_col))
        if lw == -math.inf:
            history.append((k, math.inf, 0.0, lw))
            return model, math.inf, 0.0
        refs = reference_fits(k)
        mean = sum(refs) / len(refs)
        sd = math.sqrt(sum((r - mean) ** 2 for r in refs) / len(refs)) if mean > -math.inf else 0.0
        g, s = mean - lw, gap_deviation(sd, num_random)
        history.append((k, g, s, lw))
        return model, g, s

    prev_model, prev_gap, _ = gap_at(min_k)
    for k in range(min_k + 1, max_k + 1):
        if prev_gap == math.inf:
            return k - 1, prev_model, history
        model, g, s = gap_at(k)
        if (prev_gap > g - s) if strict else (prev_gap >= g - s):
            return k - 1, prev_model, history
        prev_model, prev_gap = model, g
    return max(min_k, max_k), prev_model, history


def _storage_bytes(spark) -> int:
    """Memory of all executors that Spark may use for cached rows."""
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    it, total = status.valuesIterator(), 0
    while it.hasNext():
        total += it.next()._1()
    return total
