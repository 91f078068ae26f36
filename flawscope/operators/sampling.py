"""Duplicates, set operations, sampling, class balancing, generators.

Two kinds of sampling are offered: Spark's seeded random sampling (repeatable only while the
partitioning is), and a key-bucket form that is repeatable everywhere because a row's fate
depends on its key alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flawscope.functions.columns import q
from flawscope.operators.combine import add_row_index

# Fixed values of the key hash: ((key mod MOD) * MULT + ADD) mod MOD.  Fractions are compared with
# the whole hash, so they are exact to 1 / MOD (5e-10).
BUCKET_MULT, BUCKET_ADD, BUCKET_MOD = 1213191644, 13, 2147483647


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Drop fully duplicated rows."""
    return df.dropDuplicates()


def intersect_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Set intersection (duplicates collapse)."""
    return a.intersect(b)


def union_by_name(a: DataFrame, b: DataFrame) -> DataFrame:
    """Concatenate two tables with the same columns in any order."""
    return a.unionByName(b)


def take_subset(df: DataFrame, p: float = 0.5, seed: int = 42) -> DataFrame:
    """Random fraction ``p`` of the rows (``randomSplit`` as the reference)."""
    return df.randomSplit([p, 1 - p], seed=seed)[0]


def key_hash(key: Column) -> Column:
    """A pseudo-random order key from an integer key, the same in any engine."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(BUCKET_MOD)) * BUCKET_MULT + BUCKET_ADD,
                  F.lit(BUCKET_MOD))


def key_below(key: Column, p: float) -> Column:
    """True for a share ``p`` of all keys (no dependence on an engine's hash function); never
    for a null key."""
    return F.coalesce(key_hash(key) < F.lit(p * BUCKET_MOD), F.lit(False))


def take_subset_by_key(df: DataFrame, key: str, p: float = 0.5) -> DataFrame:
    """E4, repeatable form: keep rows whose key hash is below the fraction ``p``."""
    return df.where(key_below(q(key), p))


def train_test_split(df: DataFrame, train: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """E5: seeded 80/20 split."""
    tr, te = df.randomSplit([train, 1 - train], seed=seed)
    return tr, te


def split_label_by_key(df: DataFrame, key: str, train: float = 0.8, name: str = "split") -> DataFrame:
    """E5, repeatable form: a ``train`` / ``test`` label from the key hash."""
    return df.withColumn(name, F.when(key_below(q(key), train), F.lit("train")).otherwise(F.lit("test")))


def split_by_key(df: DataFrame, key: str, train: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """E5, repeatable form: two frames whose rows add up to the table (null keys are tested)."""
    inside = key_below(q(key), train)
    return df.where(inside), df.where(~inside)


def undersample_majority(df: DataFrame, label: str, minority, majority,
                         order_by: Sequence[str | Column], factor: float = 1.0) -> DataFrame:
    """All minority rows plus exactly ``factor * n_minority`` majority rows.

    The majority rows taken are the first ones in ``order_by``, ascending columns that form a
    total order without nulls (use a key-hash order for a random-like choice).  Only those
    columns are sorted, to find the last row taken; then one filter of the table takes both
    classes, however large n is.
    """
    keys = [(q(c) if isinstance(c, str) else c) for c in order_by]
    is_minor, is_major = q(label) == F.lit(minority), q(label) == F.lit(majority)
    n_minor, n_major = df.agg(F.count_if(is_minor), F.count_if(is_major)).first()
    n = min(int(n_minor * factor), n_major)
    if n == 0:
        return df.where(is_minor)
    if n == n_major:
        return df.where(is_minor | is_major)
    names = [f"k{i}" for i in range(len(keys))]
    ranked = add_row_index(df.where(is_major).select(*[k.alias(x) for k, x in zip(keys, names)]), names, "rank")
    last = ranked.where(F.col("rank") == n - 1).first()
    taken = keys[-1] <= F.lit(last[names[-1]])
    for k, x in zip(reversed(keys[:-1]), reversed(names[:-1])):
        taken = (k < F.lit(last[x])) | ((k == F.lit(last[x])) & taken)
    return df.where(is_minor | (is_major & taken))


def random_like(df: DataFrame, num_cols: int, low: float = 0.0, high: float = 100.0,
                seed: int = 42) -> DataFrame:
    """E7 over the rows of an existing table: same row count and partitioning."""
    return df.select(*[(F.rand(seed + i) * (high - low) + low).alias(f"col-{i}")
                       for i in range(1, num_cols + 1)])


def random_table(spark: SparkSession, num_rows: int, num_cols: int,
                 low: float = 0.0, high: float = 100.0, seed: int = 42,
                 num_partitions: int | None = None) -> DataFrame:
    """Uniform doubles in [low, high), columns ``col-1`` ...; generated on the executors."""
    base = spark.range(0, num_rows, numPartitions=num_partitions)
    return base.select(*[(F.rand(seed + i) * (high - low) + low).alias(f"col-{i}")
                         for i in range(1, num_cols + 1)])
