"""Column -> Column helpers.  Everything here is a Catalyst expression (no Python at run time)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOAT_TYPES = ("double", "float")


def q(name: str) -> Column:
    """Column by exact name; safe for hyphens, blanks and dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def clip(c: Column, lo: float, hi: float) -> Column:
    """Keep a value within [lo, hi]."""
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def missing(c: Column, dtype: str, nan_as_null: bool = False) -> Column:
    """Null, or NaN when asked and the column is floating (``isnan`` on text raises under ANSI)."""
    if nan_as_null and dtype in FLOAT_TYPES:
        return c.isNull() | F.isnan(c)
    return c.isNull()


def equals_text(c: Column, value: str) -> Column:
    """Compare through the text form, so numeric columns never raise under ANSI mode."""
    return c.cast("string") == F.lit(value)


def presence(c: Column) -> Column:
    """1 when a value is present, 0 when null (B10); NaN counts as present, like the reference."""
    return F.when(c.isNull(), F.lit(0)).otherwise(F.lit(1))


def non_null_array(cols: Sequence[Column]) -> Column:
    """The non-null cells of a row as an array of doubles."""
    return F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull())


def dot(x: Column, weights: Column) -> Column:
    """sum_i w_i * x_i of two array columns of equal length."""
    return F.aggregate(F.zip_with(x, weights, lambda a, w: a.cast("double") * w), F.lit(0.0),
                       lambda acc, v: acc + v)


def double_matrix(rows: Sequence[Sequence[float]]) -> Column:
    """A matrix as one literal (rows as arrays)."""
    return F.array(*[F.array(*[F.lit(float(v)) for v in r]) for r in rows])


def squared_distance_arrays(x: Column, y: Column) -> Column:
    """||x - y||^2 for two array columns of equal length."""
    diffs = F.zip_with(x, y, lambda a, b: (a.cast("double") - b.cast("double"))
                       * (a.cast("double") - b.cast("double")))
    return F.aggregate(diffs, F.lit(0.0), lambda acc, v: acc + v)


def nearest(x: Column, centers: Column) -> Column:
    """struct(cost, nearest) of the closest of an array of centres; the first one wins ties."""
    each = F.transform(centers, lambda c, i: F.struct(squared_distance_arrays(x, c).alias("cost"),
                                                      i.alias("nearest")))
    return F.array_min(each)


def nearest_of_few(x: Column, centers: Sequence[Sequence[float]]) -> Column:
    """``nearest`` for few centres: a plain sum per centre instead of functions over arrays."""
    each = []
    for i, c in enumerate(centers):
        cost = F.lit(0.0)
        for j, v in enumerate(c):
            step = F.get(x, F.lit(j)) - F.lit(float(v))
            cost = cost + step * step
        each.append(F.struct(cost.alias("cost"), F.lit(i).alias("nearest")))
    return F.array_min(F.array(*each))


def free_name(columns: Sequence[str], base: str) -> str:
    """``base``, lengthened until no column has that name (names are not case-sensitive)."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base += "_"
    return base
