"""Feature engineering (F1-F11): bins, quantile bins, vectors, scaling, PCA, indexers.

Fits return ``(DataFrame, model)`` so every fitted step can be stored and replayed on new
rows.  Projections stay in the JVM: PCA output is ``PCAModel.transform`` + ``VectorSlicer``
(the first n coordinates of a k-component projection are the n-component projection), and a
fixed loading matrix is one literal in an array expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import (PCA, Bucketizer, IndexToString, PCAModel, QuantileDiscretizer,
                                StandardScaler, StandardScalerModel, StringIndexer,
                                StringIndexerModel, VectorAssembler, VectorSlicer)
from pyspark.ml.functions import vector_to_array
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import DenseMatrix
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flawscope.functions.columns import dot, double_matrix, free_name, q

MAX_CATEGORIES = 100_000  # labels per column that an indexer may hold on the driver


def _replace_at_end(df: DataFrame, column: str, new_col: str) -> DataFrame:
    """Drop ``column`` and re-append the transformed one under the same name (reference order)."""
    return df.select(*[q(c) for c in df.columns if c not in (column, new_col)],
                     q(new_col).alias(column))


def binning(df: DataFrame, column: str, splits: Sequence[float],
            handle_invalid: str = "error") -> tuple[DataFrame, Bucketizer]:
    """bucket by explicit splits, [lo, hi) with the last bucket closed; in place."""
    tmp = free_name(df.columns, f"_binned_{column}")
    b = Bucketizer(splits=[float(s) for s in splits], inputCol=column, outputCol=tmp,
                   handleInvalid=handle_invalid)
    return _replace_at_end(b.transform(df), column, tmp), b


def quantile_splits(df: DataFrame, column: str, num_buckets: int, exact: bool = True,
                    relative_error: float = 0.001) -> list[float]:
    """Split points of equal-frequency buckets: the i/num_buckets quantiles, ends opened to
    +-inf and de-duplicated (as ``QuantileDiscretizer`` does)."""
    probs = [i / num_buckets for i in range(num_buckets + 1)]
    if exact:
        from flawscope.operators.stats import exact_quantiles
        qs = exact_quantiles(df, [column], probs)[column]
    else:
        qs = df.stat.approxQuantile(column, probs, relative_error)
    if not qs or qs[0] is None:
        raise ValueError(f"no values in {column}")
    qs = [float(v) for v in qs]
    qs[0], qs[-1] = float("-inf"), float("inf")
    out = []
    for v in qs:
        v = 0.0 if v == 0.0 else v
        if v not in out:
            out.append(v)
    return out


def quantile_bins(df: DataFrame, column: str, num_buckets: int, exact: bool = True,
                  relative_error: float = 0.001) -> tuple[DataFrame, Bucketizer]:
    """equal-frequency buckets, in place.

    ``exact=True`` finds the split points by distributed exact selection (bounded memory);
    ``exact=False`` is Spark's ``QuantileDiscretizer`` with ``relative_error``.
    """
    tmp = free_name(df.columns, f"_binned_{column}")
    if exact:
        b = Bucketizer(splits=quantile_splits(df, column, num_buckets, True), inputCol=column,
                       outputCol=tmp)
    else:
        b = QuantileDiscretizer(numBuckets=num_buckets, inputCol=column, outputCol=tmp,
                                relativeError=relative_error).fit(df)
    return _replace_at_end(b.transform(df), column, tmp), b


def assemble(df: DataFrame, output_col: str = "features", input_cols: Sequence[str] | None = None,
             handle_invalid: str = "error") -> DataFrame:
    """some or all columns into one vector column."""
    cols = list(input_cols) if input_cols is not None else list(df.columns)
    return VectorAssembler(inputCols=cols, outputCol=output_col,
                           handleInvalid=handle_invalid).transform(df)


def standardize(df: DataFrame, input_col: str = "features", with_mean: bool = True,
                with_std: bool = True) -> tuple[DataFrame, StandardScalerModel]:
    """zero mean / unit sample standard deviation on a vector column, in place."""
    tmp = free_name(df.columns, f"_scaled_{input_col}")
    model = StandardScaler(withMean=with_mean, withStd=with_std, inputCol=input_col,
                           outputCol=tmp).fit(df)
    return _replace_at_end(model.transform(df), input_col, tmp), model


def vector_size(df: DataFrame, vector_col: str) -> int:
    """Vector width from the column's ML metadata, else from one row."""
    meta = df.schema[vector_col].metadata.get("ml_attr", {})
    if meta.get("num_attrs"):
        return int(meta["num_attrs"])
    row = df.select(vector_col).first()
    return 0 if row is None or row[0] is None else int(row[0].size)


def vector_to_columns(df: DataFrame, vector_col: str, keep_vector: bool = False,
                      size: int | None = None, prefix: str = "f") -> DataFrame:
    """expand a vector into ``f0 ... f{n-1}`` in one projection (other columns first)."""
    n = size if size is not None else vector_size(df, vector_col)
    arr = vector_to_array(q(vector_col))
    others = [q(c) for c in df.columns if keep_vector or c != vector_col]
    return df.select(*others, *[arr.getItem(i).alias(f"{prefix}{i}") for i in range(n)])


def choose_components(shares: Sequence[float], limit: float = 0.95, rule: str = "at_most") -> int:
    """F8: number of components to keep.

    ``at_most`` (reference): the longest prefix whose cumulative share stays <= limit; an
    empty prefix means "keep all".  ``at_least``: the shortest prefix reaching the limit.
    """
    total, n = 0.0, 0
    for s in shares:
        total += s
        if rule == "at_least":
            n += 1
            if total >= limit:
                return n
        elif total <= limit:
            n += 1
        else:
            break
    return n if n > 0 else len(shares)


def explained_prefix(shares: DataFrame, order_col: str, share_col: str, limit: float = 0.95) -> DataFrame:
    """F8, table form over a small (component, share) table: running share and both keep flags."""
    w = Window.orderBy(q(order_col)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = F.sum(q(share_col)).over(w)
    prev = cum - q(share_col)
    return shares.select(q(order_col), q(share_col), cum.alias("cum_share"),
                         (cum <= F.lit(limit)).alias("keep_at_most"),
                         (prev < F.lit(limit)).alias("keep_at_least"))


def pca(df: DataFrame, max_components: int, assemble_features: bool = True,
        standardize_features: bool = True, explained_variance: float = 0.95,
        exclude: Sequence[str] = (), features_col: str = "features", rule: str = "at_most",
        ) -> tuple[DataFrame, DenseMatrix, dict]:
    """(assemble) -> clip k -> (standardise) -> PCA -> keep components by explained
    variance -> project -> expand.  Output columns: the projected vector, the excluded
    columns, then ``f0 ... f{n-1}``.  Returns (table, loadings d x n, fitted stages)."""
    if not 0 < explained_variance <= 1:
        raise ValueError("explained_variance must be in (0, 1]")
    data, stages = df, {}
    keep = [c for c in exclude if c in df.columns]
    if assemble_features:
        data = assemble(df, features_col, [c for c in df.columns if c not in set(exclude)])
        d = len([c for c in df.columns if c not in set(exclude)])
    else:
        d = vector_size(df, features_col)
    k = max(1, min(max_components, d))
    if standardize_features:
        data, stages["scaler"] = standardize(data, features_col)
    model = PCA(k=k, inputCol=features_col, outputCol="_pca").fit(data)
    stages["pca"] = model
    n = choose_components(list(model.explainedVariance.toArray()), explained_variance, rule)
    stages["n_components"] = n
    pc = DenseMatrix(model.pc.numRows, n, model.pc.toArray()[:, :n].flatten(order="F").tolist())
    slicer = VectorSlicer(inputCol="_pca", outputCol="_proj", indices=list(range(n)))
    fitted = ([VectorAssembler(inputCols=[c for c in df.columns if c not in set(exclude)],
                               outputCol=features_col)] if assemble_features else [])
    pca_in = features_col
    if standardize_features:  # replay form: scaler writes a side column the PCA reads
        fitted.append(stages["scaler"].copy().setOutputCol("_scaled"))
        pca_in = "_scaled"
    stages["chain"] = PipelineModel(stages=[*fitted, model.copy().setInputCol(pca_in), slicer])
    projected = slicer.transform(model.transform(data))
    out = projected.select(q("_proj").alias(features_col), *[q(c) for c in keep])
    return vector_to_columns(out, features_col, keep_vector=True, size=n), pc, stages


def project_fixed(df: DataFrame, array_col: str, loadings: Sequence[Sequence[float]],
                  keep: Sequence[str] = (), prefix: str = "c") -> DataFrame:
    """components ``c_j = sum_i x_i * W[i][j]`` for a given d x n loading matrix.

    The matrix is one literal and the product one array expression, for any d and n."""
    w = np.asarray(loadings, dtype="float64")
    comps = F.transform(double_matrix(w.T.tolist()), lambda c: dot(q(array_col), c))
    named = [F.col("_c").getItem(j).alias(f"{prefix}{j}") for j in range(w.shape[1])]
    return df.select(*[q(c) for c in keep], comps.alias("_c")).select(*[q(c) for c in keep], *named)


def feature_covariance(df: DataFrame, columns: Sequence[str] | None = None,
                       features_col: str | None = None) -> DataFrame:
    """Sample covariance matrix of numeric columns (or of a vector column) as (i, j, cov) rows,
    upper triangle.  One distributed Gramian pass (``Correlation``) plus one ``Summarizer``
    pass - the same d x d statistics PCA uses; never d^2 separate SQL aggregates."""
    from pyspark.ml.stat import Correlation, Summarizer

    if features_col is None:
        df = assemble(df, "_cov_x", list(columns or df.columns))
        features_col = "_cov_x"
    corr = Correlation.corr(df, features_col, "pearson").first()[0].toArray()
    std = df.select(Summarizer.metrics("std").summary(q(features_col)).alias("s")) \
        .first()["s"]["std"].toArray()
    d = len(std)
    rows = [(i, j, 0.0 if std[i] == 0 or std[j] == 0 else float(corr[i, j] * std[i] * std[j]))
            for i in range(d) for j in range(i, d)]
    return df.sparkSession.createDataFrame(rows, "i int, j int, cov double")


def check_categories(df: DataFrame, columns: Sequence[str], limit: int) -> None:
    """Refuse columns with more distinct values than ``limit`` (one approximate aggregate): a
    fitted indexer holds all labels of its columns on the driver."""
    from flawscope.operators.stats import approx_distinct_counts

    row = approx_distinct_counts(df, columns).first()
    if wide := [c for c in columns if row[c] > limit * 1.1]:
        raise ValueError(f"too many distinct values to index (over {limit}): {wide}")


def index_features(df: DataFrame, columns: Sequence[str], prefix: str = "indexed-",
                   order: str = "frequencyDesc", handle_invalid: str = "error",
                   max_categories: int = MAX_CATEGORIES) -> tuple[DataFrame, StringIndexerModel]:
    """index each column by descending frequency (ties alphabetical); numbers become text.

    Columns with more than ``max_categories`` distinct values are refused."""
    check_categories(df, columns, max_categories)
    model = StringIndexer(inputCols=list(columns), outputCols=[prefix + c for c in columns],
                          stringOrderType=order, handleInvalid=handle_invalid).fit(df)
    return model.transform(df), model


def index_label(df: DataFrame, target: str, output: str = "label",
                order: str = "frequencyDesc") -> tuple[DataFrame, StringIndexerModel]:
    """index the target (fit on the table given - the whole table in the reference)."""
    model = StringIndexer(inputCol=target, outputCol=output, stringOrderType=order).fit(df)
    return model.transform(df), model


def index_to_label(df: DataFrame, labels: Sequence[str], input_col: str = "prediction",
                   output_col: str | None = None, target: str = "label") -> DataFrame:
    """predicted index back to the label text, in ``predicted-<target>``."""
    out = output_col or f"predicted-{target}"
    return IndexToString(inputCol=input_col, outputCol=out, labels=list(labels)).transform(df)
