"""Column and row cleaning.

Every per-column transformation is ONE ``select`` over all columns (never a ``withColumn``
fold: with ~1,000 columns a fold makes analysis quadratic).  Statistics that decide which
columns survive are ONE aggregate; only that single row of flags reaches the driver.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.ml.feature import Imputer, ImputerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flawscope.functions.columns import equals_text, non_null_array, presence, q

UNORDERABLE_PREFIXES = ("map<", "struct<vector", "vector")


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    """B1: drop named columns; unknown names are ignored."""
    return df.drop(*names)


def keep_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """B2: keep only the named columns, in the table's own order; unknown names are ignored."""
    keep = set(names)
    return df.select(*[q(c) for c in df.columns if c in keep])


def rename_column(df: DataFrame, before: str, after: str) -> DataFrame:
    """B3."""
    return df.withColumnRenamed(before, after)


def apply_over_columns(df: DataFrame, f: Callable[[Column], Column],
                       columns: Sequence[str] | None = None) -> DataFrame:
    """Apply ``f`` to every (or every listed) column in a single projection."""
    chosen = set(df.columns if columns is None else columns)
    return df.select(*[(f(q(c)) if c in chosen else q(c)).alias(c) for c in df.columns])


def constant_column_flags(df: DataFrame, approx: bool = False, rsd: float = 0.05) -> dict[str, bool]:
    """True for columns holding fewer than two distinct non-null values (one aggregate job).

    Exact form: ``min(c) < max(c)`` over non-null values - exact and O(1) memory per column, so
    it costs the same as HyperLogLog.  ``approx=True`` is the HyperLogLog form
    (``approx_count_distinct <= 1``), which can merge two values into one register.
    """
    kinds = dict(df.dtypes)
    exprs, names = [], []
    for i, c in enumerate(df.columns):
        if kinds[c].startswith(UNORDERABLE_PREFIXES):
            continue  # vectors / maps: neither orderable nor hashable by HLL; never dropped
        if approx:
            e = F.approx_count_distinct(q(c), rsd) <= 1
        else:
            mn, mx = F.min(q(c)), F.max(q(c))
            e = F.coalesce(~(mn < mx), F.lit(True))
        exprs.append(e.alias(f"_c{i}"))
        names.append(c)
    if not exprs:
        return {}
    row = df.agg(*exprs).first()
    return {c: bool(row[i]) for i, c in enumerate(names)}


def drop_constant_columns(df: DataFrame, approx: bool = False, exclude: Sequence[str] = (),
                          rsd: float = 0.05) -> DataFrame:
    """Drop columns with 0 or 1 distinct non-null values; order kept; ``exclude`` protected."""
    protect = set(exclude)
    candidates = df.select(*[q(c) for c in df.columns if c not in protect])
    flags = constant_column_flags(candidates, approx=approx, rsd=rsd)
    return df.select(*[q(c) for c in df.columns if c in protect or not flags.get(c, False)])


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any null (or NaN)."""
    return df.na.drop(how="any")


def remove_rows_with_value(df: DataFrame, value: str, strict: bool = True) -> DataFrame:
    """Drop rows where some column equals ``value`` (compared as text).

    ``strict`` keeps the reference's set semantics: a cell that is null makes ``c <> value``
    unknown, so such rows go too, and duplicates collapse (``distinct``).  ``strict=False`` is
    the plain filter that keeps nulls and duplicates.
    """
    if strict:
        cond = reduce(lambda a, b: a & b, [~equals_text(q(c), value) for c in df.columns])
        return df.where(cond).distinct()
    hit = reduce(lambda a, b: a | b,
                 [F.coalesce(equals_text(q(c), value), F.lit(False)) for c in df.columns])
    return df.where(~hit)


def values_to_null(df: DataFrame, value: str) -> DataFrame:
    """Replace a sentinel with null in every column (text comparison, ANSI-safe)."""
    return apply_over_columns(df, lambda c: F.when(equals_text(c, value), F.lit(None)).otherwise(c))


def trim_values(df: DataFrame) -> DataFrame:
    """Remove whitespace from column names and trim string values."""
    out = []
    for name, dtype in df.dtypes:
        c = F.trim(q(name)) if dtype == "string" else q(name)
        out.append(c.alias(re.sub(r"\s", "", name)))
    return df.select(*out)


def binary_conversion(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Presence map - null -> 0, anything else -> 1, except excluded columns."""
    skip = set(exclude)
    return df.select(*[q(c) if c in skip else presence(q(c)).alias(c) for c in df.columns])


def impute(df: DataFrame, strategy: str = "mean", exclude: Sequence[str] = (),
           relative_error: float = 0.001) -> tuple[DataFrame, ImputerModel]:
    """Replace null/NaN by the column mean or median; returns the fitted model too.

    The model is a Spark ``ImputerModel`` so it can be stored and reused on new rows.  For an
    exact median over very large tables use ``impute_exact_median`` (bounded memory).
    """
    cols = [c for c in df.columns if c not in set(exclude)]
    imputer = Imputer(inputCols=cols, outputCols=cols, strategy=strategy,
                      relativeError=relative_error)
    model = imputer.fit(df)
    return model.transform(df), model


def impute_with(df: DataFrame, surrogates: dict[str, float]) -> DataFrame:
    """Fill nulls/NaN with given per-column values, keeping each column's type."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        if c in surrogates:
            v = F.lit(surrogates[c]).cast(kinds[c])
            miss = q(c).isNull() | (F.isnan(q(c)) if kinds[c] in ("double", "float") else F.lit(False))
            out.append(F.when(miss, v).otherwise(q(c)).alias(c))
        else:
            out.append(q(c))
    return df.select(*out)


def impute_exact_median(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[DataFrame, dict]:
    """B11 (median, exact): lower-middle median found by distributed selection, then filled."""
    from flawscope.operators.stats import exact_quantiles

    cols = [c for c in df.columns if c not in set(exclude)]
    kinds = dict(df.dtypes)
    clean = df.select(*[F.when(~F.isnan(q(c)), q(c)).alias(c) if kinds[c] in ("double", "float")
                        else q(c) for c in cols])
    med = exact_quantiles(clean, cols, [0.5])
    surrogates = {c: med[c][0] for c in cols}
    missing = [c for c, v in surrogates.items() if v is None]
    if missing:
        raise ValueError(f"surrogate cannot be computed for all-null columns {missing}")
    return impute_with(df, surrogates), surrogates


def add_random_col(df: DataFrame, name: str, seed: int = 42) -> DataFrame:
    """A random 0/1 column."""
    return df.withColumn(name, F.when(F.rand(seed) > 0.5, F.lit(1)).otherwise(F.lit(0)))


def filter_label(df: DataFrame, column: str, value) -> DataFrame:
    """B13."""
    return df.where(q(column) == F.lit(value))


def split_by_value(df: DataFrame, column: str, max_groups: int | None = None) -> list[tuple[object, DataFrame]]:
    """One null-safe filtered frame per distinct value of a low-cardinality column.

    Only the distinct values reach the driver (the result is one frame for each of them); with
    ``max_groups`` more values than that are refused before they are fetched.
    """
    values = df.select(q(column)).distinct()
    if max_groups is not None:
        values = values.limit(max_groups + 1)
    values = [r[0] for r in values.collect()]
    if max_groups is not None and len(values) > max_groups:
        raise ValueError(f"{column} has more than {max_groups} distinct values")
    return [(v, df.where(q(column).eqNullSafe(F.lit(v)))) for v in values]


def row_to_array(df: DataFrame, columns: Sequence[str], name: str = "values",
                 keep: Sequence[str] = ()) -> DataFrame:
    """The non-null cells of each row as an array of doubles."""
    return df.select(*[q(c) for c in keep], non_null_array([q(c) for c in columns]).alias(name))
