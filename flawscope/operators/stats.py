"""One-pass statistics (D1-D11) and exact quantiles by distributed selection.

Each statistic over many columns is a single ``agg`` (the reference ran one job per column
for some of them).  Results are one-row DataFrames so they can be joined, unioned or stored;
only the callers that need a Python number call ``.first()``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flawscope.functions.columns import missing, q


def count_nulls(df: DataFrame, columns: Sequence[str] | None = None,
                nan_as_null: bool = False) -> DataFrame:
    """Null (optionally NaN) count per column, one row, BIGINT counts."""
    kinds = dict(df.dtypes)
    cols = list(columns or df.columns)
    return df.agg(*[F.sum(missing(q(c), kinds[c], nan_as_null).cast("long")).alias(c) for c in cols])


def distinct_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct non-null count per column."""
    cols = list(columns or df.columns)
    return df.agg(*[F.count_distinct(q(c)).alias(c) for c in cols])


def approx_distinct_counts(df: DataFrame, columns: Sequence[str] | None = None,
                           rsd: float = 0.05) -> DataFrame:
    """D3: HyperLogLog++ distinct count per column."""
    cols = list(columns or df.columns)
    return df.agg(*[F.approx_count_distinct(q(c), rsd).alias(c) for c in cols])


def max_distinct_values(df: DataFrame, columns: Sequence[str] | None = None,
                        approx: bool = False) -> DataFrame:
    """The largest distinct count over the columns (feeds ``maxBins``), one row."""
    cols = list(columns or df.columns)
    per = [F.approx_count_distinct(q(c)) if approx else F.count_distinct(q(c)) for c in cols]
    inner = df.agg(*[e.alias(f"_d{i}") for i, e in enumerate(per)])
    names = [F.col(f"_d{i}") for i in range(len(cols))]
    return inner.select((F.greatest(*names) if len(names) > 1 else names[0]).alias("max_distinct"))


def distinct_values_count(df: DataFrame, column: str) -> DataFrame:
    """Rows per value (map-side combined, so a hot value costs no more than a cold one)."""
    return df.groupBy(q(column)).count()


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """D6."""
    return df.select(q(column)).distinct()


def column_ranges(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per-column min and max in one aggregate (``min_<c>``, ``max_<c>``)."""
    cols = list(columns or df.columns)
    exprs = []
    for c in cols:
        exprs += [F.min(q(c)).alias(f"min_{c}"), F.max(q(c)).alias(f"max_{c}")]
    return df.agg(*exprs)


def population_stats(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, population variance and population standard deviation."""
    aggs = [F.avg(q(column)).alias("mean"), F.var_pop(q(column)).alias("variance"),
            F.stddev_pop(q(column)).alias("std_dev")]
    return df.groupBy(*[q(b) for b in by]).agg(*aggs) if by else df.agg(*aggs)


def column_to_array(df: DataFrame, column: str, by: Sequence[str], name: str = "values") -> DataFrame:
    """The values of a column per group as one sorted array (groups must be bounded)."""
    return df.groupBy(*[q(b) for b in by]).agg(F.array_sort(F.collect_list(q(column))).alias(name))


# --------------------------------------------------------------------------------------------
# Exact quantiles with bounded memory
# --------------------------------------------------------------------------------------------

GRID = 200           # quantiles of one sketch; a round narrows a target's range to about 2 / GRID of it
TARGETS_AT_ONCE = 100  # below Spark's limit of groups for sketches in a hash aggregate
INTEGRAL = ("tinyint", "smallint", "int", "bigint")


class _Target:
    """One wanted rank of one column, and the range that still holds it."""

    __slots__ = ("col", "pi", "rank", "n", "lo", "lo_inc", "hi", "hi_inc", "value", "done")

    def __init__(self, col, pi, rank, n):
        self.col, self.pi, self.rank, self.n = col, pi, rank, n
        self.lo = self.hi = None
        self.lo_inc = self.hi_inc = True
        self.value, self.done = None, n == 0


def exact_quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float],
                    max_candidates: int = 100_000, accuracy: int = 10_000) -> dict[str, list]:
    """Exact quantiles: the value of 1-based rank ``ceil(p * n)`` among the non-null values.

    That is the rule of ``approxQuantile(..., relativeError=0)``, but without holding every
    value in one buffer, and in the column's own type (a BIGINT beyond 2^53 stays exact).  The
    columns are read as (column, value) rows, so a plan's size does not depend on how many there
    are.  Each round is two aggregates: a sketch of the values inside every target's range, which
    gives a narrower bracket, and exact counts below / at / inside / at / above its ends.  Once
    the candidates of some targets fit the shared budget of ``max_candidates`` values they are
    fetched together in one job and the answers are read off.  Heavy duplicates end the search
    at once (a bracket end is the answer).
    """
    probs, kinds = list(probs), dict(df.dtypes)
    of_type: dict[str, list[str]] = {}
    for c in columns:
        kind = "bigint" if kinds[c] in INTEGRAL else "double" if kinds[c] == "float" else kinds[c]
        of_type.setdefault(kind, []).append(c)
    # several passes follow: keep only the target columns, once, instead of re-running the
    # upstream plan (often a shuffle) for every pass
    df = df.select(*[q(c) for c in dict.fromkeys(columns)]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        out = {}
        for kind, cols in of_type.items():
            out.update(_select_exact(df, cols, kind, probs, max_candidates, accuracy))
        return {c: out[c] for c in columns}
    finally:
        df.unpersist()


def _bounded(df: DataFrame, columns: Sequence[str], kind: str, targets: Sequence[_Target],
             *more: tuple[str, list]) -> DataFrame:
    """(t, v) rows of the values inside each target's range, with further per-target values."""
    used = sorted({t.col for t in targets}, key=columns.index)
    at = {c: i for i, c in enumerate(used)}
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("c"), q(c).cast(kind).alias("v"))
                                          for c, i in at.items()])).alias("x")).select("x.c", "x.v") \
        .where(F.col("v").isNotNull())
    schema = f"t int, c int, lo {kind}, lo_inc boolean, hi {kind}, hi_inc boolean" + "".join(
        f", {name} {kind}" for name, _ in more)
    rows = [(j, at[t.col], t.lo, t.lo_inc, t.hi, t.hi_inc, *(values[j] for _, values in more))
            for j, t in enumerate(targets)]
    bounds = F.broadcast(df.sparkSession.createDataFrame(rows, schema))  # a row per target
    inside = """(lo IS NULL OR v > lo OR (lo_inc AND v = lo)) AND (hi IS NULL OR v < hi OR (hi_inc AND v = hi))"""
    return cells.join(bounds, "c").where(inside)


def _fitting(targets: list[_Target], budget: int) -> list[_Target]:
    """The targets with the fewest candidates, as many as fit the budget together."""
    out, used = [], 0
    for t in sorted(targets, key=lambda t: t.n):
        if used + t.n > budget:
            break
        out.append(t)
        used += t.n
    return out


def _select_exact(df, columns, kind, probs, max_candidates, accuracy):
    sizes = {r["t"]: r["n"] for r in _bounded(df, columns, kind, [_Target(c, 0, 0, 1) for c in columns])
             .groupBy("t").agg(F.count("*").alias("n")).collect()}
    targets = []
    for i, c in enumerate(columns):
        n = sizes.get(i, 0)
        targets += [_Target(c, pi, min(n, max(1, math.ceil(p * n))), n) for pi, p in enumerate(probs)]

    while active := [t for t in targets if not t.done]:
        if small := _fitting(active, max_candidates):
            got: dict[int, list] = {j: [] for j in range(len(small))}
            for r in _bounded(df, columns, kind, small).select("t", "v").collect():
                got[r["t"]].append(r["v"])
            for j, t in enumerate(small):
                t.value, t.done = sorted(got[j])[t.rank - 1], True
            continue
        part = active[:TARGETS_AT_ONCE]
        grid = [i / GRID for i in range(GRID + 1)]
        sketch = {r["t"]: r["s"] for r in _bounded(df, columns, kind, part).groupBy("t")
                  .agg(F.percentile_approx("v", grid, accuracy).alias("s")).collect()}
        a, b = [], []
        for j, t in enumerate(part):
            at = (t.rank - 0.5) / t.n * GRID
            a.append(sketch[j][max(0, math.floor(at - 0.1))])
            b.append(sketch[j][min(GRID, math.ceil(at + 0.1))])
        v = F.col("v")
        counts = {r["t"]: r for r in _bounded(df, columns, kind, part, ("a", a), ("b", b)).groupBy("t").agg(
            F.count_if(v < F.col("a")).alias("lt"), F.count_if(v == F.col("a")).alias("ea"),
            F.count_if((v > F.col("a")) & (v < F.col("b"))).alias("mid"),
            F.count_if((v == F.col("b")) & (F.col("a") != F.col("b"))).alias("eb")).collect()}
        for j, t in enumerate(part):
            lt, ea, mid, eb = (counts[j][k] for k in ("lt", "ea", "mid", "eb"))
            r = t.rank
            if r <= lt:
                t.hi, t.hi_inc, t.n = a[j], False, lt
            elif r <= lt + ea:
                t.value, t.done = a[j], True
            elif r <= lt + ea + mid:
                t.lo, t.lo_inc, t.hi, t.hi_inc = a[j], False, b[j], False
                t.rank, t.n = r - lt - ea, mid
            elif r <= lt + ea + mid + eb:
                t.value, t.done = b[j], True
            else:
                used = lt + ea + mid + eb
                t.lo, t.lo_inc = b[j], False
                t.rank, t.n = r - used, t.n - used

    out = {c: [None] * len(probs) for c in columns}
    for t in targets:
        out[t.col][t.pi] = t.value
    return out
