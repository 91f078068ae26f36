"""Helpers that size work to the cluster: materialization, scratch folders, tree buffers."""

from pyspark.sql import functions as F

from flawscope.operators.classify import _size_mb, tree_memory_mb
from flawscope.session import drop_scratch, materialize, scratch_dir
from flawscope.sources.models import path_exists


def test_materialize_modes_keep_rows(spark):
    df = spark.range(0, 1000, numPartitions=4).select("id", (F.col("id") % 7).alias("g"))
    for mode in ("checkpoint", "table", "persist"):
        out = materialize(df, mode)
        assert sorted(out.collect()) == sorted(df.collect()), mode
    assert scratch_dir(spark, "x") != scratch_dir(spark, "x")


def test_scratch_is_removed(spark):
    path = scratch_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    drop_scratch(spark, path)
    assert not path_exists(spark, path)


def test_tree_memory_follows_executor_size(spark):
    assert (_size_mb("4g"), _size_mb("512m"), _size_mb("2048k"), _size_mb("1073741824")) == (4096, 512, 2, 1024)
    mb = tree_memory_mb(spark)
    assert 256 <= mb <= 2048
