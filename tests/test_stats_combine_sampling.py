"""Statistics (D), joins / row index (C), sampling (E)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flawscope.operators import combine as C
from flawscope.operators import sampling as E
from flawscope.operators import stats as D
from flawscope.sources.tables import load_table


@pytest.mark.parametrize("col", ["l_extendedprice", "l_quantity", "l_discount"])
def test_exact_quantiles_match_spark_exact(spark, col):
    li = load_table(spark, SF_SMALL, "lineitem")
    probs = [0.0, 0.1, 0.25, 0.5, 0.7, 0.9, 1.0]
    expected = li.stat.approxQuantile(col, probs, 0.0)
    # tiny candidate limit and accuracy force several narrowing rounds
    got = D.exact_quantiles(li, [col], probs, max_candidates=200, accuracy=50)[col]
    assert got == expected


def test_exact_quantiles_heavy_duplicates(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 10 == 0, F.col("id")).otherwise(0).cast("double").alias("x"))
    probs = [0.1, 0.5, 0.9, 0.95]
    assert D.exact_quantiles(df, ["x"], probs, max_candidates=100, accuracy=20)["x"] == \
        df.stat.approxQuantile("x", probs, 0.0)


def test_max_distinct_and_ranges(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "n int, s string")
    assert D.max_distinct_values(df).first()[0] == 3
    r = D.column_ranges(df, ["n"]).first()
    assert (r.min_n, r.max_n) == (1, 3)


def test_add_row_index_consecutive_across_partitions(spark):
    df = spark.range(0, 5000, numPartitions=7).select((F.col("id") * 7919 % 5003).alias("k"))
    out = C.add_row_index(df, ["k"], "index")
    rows = out.orderBy("k").collect()
    assert [r["index"] for r in rows] == list(range(5000))


def test_positional_merge_requires_equal_counts(spark):
    a, b = spark.range(3), spark.range(4)
    with pytest.raises(ValueError):
        C.positional_merge(a, b, ["id"], ["id"])
    merged = C.positional_merge(spark.range(3).withColumnRenamed("id", "x"),
                                spark.range(3).select((F.col("id") * 10).alias("y")), ["x"], ["y"])
    assert merged.columns == ["y", "x"]
    assert sorted(merged.collect()) == [(0, 0), (10, 1), (20, 2)]


def test_join_members_inner_multiplies_semi_does_not(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    members = spark.createDataFrame([(1,), (1,)], "id int")
    assert C.join_members(df, members, "id").count() == 2
    assert C.join_members(df, members, "id", semi=True).count() == 1


def test_undersample_exact_count(spark):
    df = spark.range(0, 1000, numPartitions=5).select("id", (F.col("id") % 4 == 0).cast("int").alias("y"))
    out = E.undersample_majority(df, "y", 1, 0, [E.key_hash(F.col("id")), F.col("id")], factor=2.0)
    counts = dict(out.groupBy("y").count().collect())
    assert counts == {1: 250, 0: 500}


def test_key_split_is_stable_and_proportional(spark):
    o = load_table(spark, SF_SMALL, "orders")
    a = E.split_label_by_key(o, "o_orderkey").where("split = 'train'").count()
    b = E.split_label_by_key(o.repartition(13), "o_orderkey").where("split = 'train'").count()
    assert a == b and 0.75 < a / o.count() < 0.85


def test_set_operations(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "n int, s string")
    b = spark.createDataFrame([("x", 1)], "s string, n int")
    assert E.intersect_rows(a, b.select("n", "s")).collect() == [(1, "x")]
    assert E.union_by_name(a, b).count() == 4
    assert E.drop_duplicates(a).count() == 2


def test_random_table_range(spark):
    df = E.random_table(spark, 500, 3, 5.0, 6.0)
    assert df.columns == ["col-1", "col-2", "col-3"]
    r = df.agg(F.min("col-1"), F.max("col-3")).first()
    assert 5.0 <= r[0] and r[1] < 6.0


def test_exact_quantiles_property(spark):
    """Random values with duplicates and nulls: the rank rule ceil(p * n) on sorted non-nulls."""
    import math
    import random

    rng = random.Random(11)
    for trial in range(4):
        n = rng.randint(1, 400)
        vals = [None if rng.random() < 0.2 else float(rng.randint(-20, 20 + trial * 50)) for _ in range(n)]
        df = spark.createDataFrame([(v,) for v in vals], "x double").repartition(3)
        probs = [0.0, 0.05, 0.33, 0.5, 0.99, 1.0]
        got = D.exact_quantiles(df, ["x"], probs, max_candidates=7, accuracy=8)["x"]
        clean = sorted(v for v in vals if v is not None)
        if not clean:
            assert got == [None] * len(probs)
            continue
        m = len(clean)
        want = [clean[min(m, max(1, math.ceil(p * m))) - 1] for p in probs]
        assert got == want, (trial, got, want)


def test_approx_distinct_within_three_rsd(spark):
    li = load_table(spark, SF_SMALL, "lineitem")
    cols = ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"]
    exact = D.distinct_counts(li, cols).first()
    approx = D.approx_distinct_counts(li, cols, rsd=0.05).first()
    for c in cols:
        assert abs(approx[c] - exact[c]) <= 3 * 0.05 * exact[c], c
