"""Joins and row alignment (C1-C3), plus a distributed consecutive row index.

A consecutive 0-based index over an ordered table is computed without a single-partition
window: the table is range-sorted, ``monotonically_increasing_id`` gives (partition, position)
for free, one small aggregate counts rows per partition (at most ``numPartitions`` rows reach
the driver) and each row adds its partition's offset through a literal array.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flawscope.functions.columns import free_name, q
from flawscope.session import materialize

_POS_BITS = 33  # monotonically_increasing_id: partition id in the upper 31 bits


def join_members(df: DataFrame, members: DataFrame, key: str, semi: bool = False) -> DataFrame:
    """Rows of ``df`` whose key appears in ``members``.

    ``semi=False`` is the reference's inner join on the key only (duplicate member keys
    multiply rows); ``semi=True`` is a left-semi join (no duplication, no columns added).
    Strategy (broadcast / shuffle) is left to AQE.
    """
    ids = members.select(q(key))
    return df.join(ids, on=key, how="left_semi" if semi else "inner")


def _indexed(df: DataFrame, order_by: Sequence[str | Column] | None, name: str) -> tuple[DataFrame, int]:
    """The table with its row index, and how many rows it has."""
    base = df.orderBy(*order_by) if order_by else df
    mid = free_name([*df.columns, name], "_mid")
    # the sorted table is written once: ids and counts must see the same partitions
    tagged = materialize(base.withColumn(mid, F.monotonically_increasing_id()), "table")
    part = F.shiftright(q(mid), _POS_BITS)
    counts = dict(tagged.groupBy(part.alias("p")).count().collect())
    if not counts:
        return tagged.drop(mid).withColumn(name, F.lit(None).cast("long")), 0
    sizes = [counts.get(p, 0) for p in range(max(counts) + 1)]
    offsets = F.array(*[F.lit(o).cast("long") for o in [0, *accumulate(sizes)][:-1]])
    idx = F.element_at(offsets, (part + 1).cast("int")) + q(mid) - F.shiftleft(part, _POS_BITS)
    return tagged.select(*[q(c) for c in df.columns], idx.alias(name)), sum(sizes)


def add_row_index(df: DataFrame, order_by: Sequence[str | Column] | None, name: str = "index") -> DataFrame:
    """Append a consecutive 0-based LONG index following ``order_by``.

    ``order_by`` must be a total order (unique key) for the index to be reproducible; ``None``
    numbers rows in the table's current partition order (only stable for files read in order).
    """
    return _indexed(df, order_by, name)[0]


def positional_merge(one: DataFrame, two: DataFrame,
                     one_order: Sequence[str | Column] | None,
                     two_order: Sequence[str | Column] | None) -> DataFrame:
    """Pair the i-th row of ``two`` with the i-th row of ``one``; output = two's columns,
    then one's.  Equal row counts are required (checked)."""
    pos = free_name([*one.columns, *two.columns], "_pos")
    a, n2 = _indexed(two, two_order, pos)
    b, n1 = _indexed(one, one_order, pos)
    if n1 != n2:
        raise ValueError(f"the two tables must have the same number of rows ({n1} != {n2})")
    return a.join(b, pos).drop(pos)
