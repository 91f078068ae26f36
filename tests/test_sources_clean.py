"""Sources (A) and cleaning (B): edge cases from hand-made fixtures."""

import math
import os

import pytest
from pyspark.sql import functions as F

from flawscope.operators import clean as B
from flawscope.operators import stats as D
from flawscope.sources.models import path_exists
from flawscope.sources.tables import TableSpec, read_csv, table_shape, write_csv


def _local(uri: str) -> str:
    return uri[len("file:"):] if uri.startswith("file:") else uri


def test_dropmalformed_count_equals_collect(spark, tmp_out):
    path = _local(tmp_out)
    os.makedirs(path)
    with open(os.path.join(path, "t.csv"), "w") as fh:
        fh.write("a,b,c\n1,x,2.0\n2,3\nq,4,5.0\n7,y,8.0\n 4,z,6.0\n")
    df = read_csv(spark, path, TableSpec("t", ddl="a INT, b STRING, c DOUBLE"))
    rows = df.collect()
    assert len(rows) == 2 == df.count() == df.select("a").count()
    assert sorted(r.a for r in rows) == [1, 7]


def test_blank_padded_ints_kept_when_asked(spark, tmp_out):
    path = _local(tmp_out)
    os.makedirs(path)
    with open(os.path.join(path, "t.csv"), "w") as fh:
        fh.write("a;b\n 1;x\n2 ;y\n")
    df = read_csv(spark, path, TableSpec("t", ddl="a INT, b STRING", delimiter=";"),
                  ignore_leading_blanks=True, ignore_trailing_blanks=True)
    assert sorted(r.a for r in df.collect()) == [1, 2]


def test_semicolon_gzip_roundtrip_with_nulls(spark, tmp_out):
    src = spark.createDataFrame([(1, None, "a b"), (2, 2.5, None)], "id bigint, v double, s string")
    write_csv(src, tmp_out, sep=";", compression="gzip")
    back = read_csv(spark, tmp_out, TableSpec("t", ddl="id BIGINT, v DOUBLE, s STRING", delimiter=";"))
    assert sorted(back.collect()) == sorted(src.collect())
    assert path_exists(spark, tmp_out)
    assert not path_exists(spark, tmp_out + "-missing")


def test_inferred_schema(spark, tmp_out):
    src = spark.createDataFrame([(1, 2.5, "x")], "a int, b double, c string")
    write_csv(src, tmp_out, sep=",")
    back = read_csv(spark, tmp_out, None, sep=",")
    assert dict(back.dtypes) == {"a": "int", "b": "double", "c": "string"}


def test_table_shape(spark):
    df = spark.range(10).withColumn("x", F.lit(1))
    row = table_shape(df).first()
    assert (row.n_rows, row.n_cols, row.column_names) == (10, 2, "id,x")


def test_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    assert B.drop_constant_columns(empty).columns == []
    assert B.drop_constant_columns(empty, exclude=["a"]).columns == ["a"]
    row = D.count_nulls(empty).first()
    assert row.a is None and row.b is None


@pytest.mark.parametrize("approx", [False, True])
def test_drop_constant_columns(spark, approx):
    nan = float("nan")
    df = spark.createDataFrame(
        [(1, None, 5, 7.0, 1.0, nan, nan, "x"), (2, None, 5, None, 2.0, 1.0, nan, "x"),
         (3, None, 5, 7.0, None, nan, nan, "x")],
        "id int, all_null double, const int, const_nulls double, two double, nan_one double, "
        "nan_only double, s string")
    out = B.drop_constant_columns(df, approx=approx)
    assert out.columns == ["id", "two", "nan_one"]
    kept = B.drop_constant_columns(df.where("id = 1"), approx=approx, exclude=["id"])
    assert kept.columns == ["id"]


def test_values_to_null_int_sentinel_under_ansi(spark):
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    df = spark.createDataFrame([(1, "?"), (2, "a"), (3, "")], "n int, s string")
    out = B.values_to_null(B.values_to_null(df, "?"), "").orderBy("n").collect()
    assert [(r.n, r.s) for r in out] == [(1, None), (2, "a"), (3, None)]
    assert dict(B.values_to_null(df, "?").dtypes) == {"n": "int", "s": "string"}


def test_trim_values_spaced_and_hyphenated_names(spark):
    df = spark.createDataFrame([(" a ", 1.0)], "` my col ` string, `urban-pop` double")
    out = B.trim_values(df)
    assert out.columns == ["mycol", "urban-pop"]
    assert out.first().mycol == "a"
    flags = B.binary_conversion(out, exclude=["mycol"])
    assert flags.first()["urban-pop"] == 1


def test_remove_rows_with_value_strict_and_plain(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "b"), ("v", "c"), (None, "d")], "x string, y string")
    strict = B.remove_rows_with_value(df, "v")
    plain = B.remove_rows_with_value(df, "v", strict=False)
    assert sorted(strict.collect()) == [("a", "b")]
    assert sorted(plain.collect(), key=str) == sorted([("a", "b"), ("a", "b"), (None, "d")], key=str)


def test_impute_mean_truncates_int_and_median_is_lower_middle(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (None, None), (4, float("nan"))], "i int, d double")
    mean, _ = B.impute(df, "mean")
    assert mean.where("i IS NOT NULL").count() == 4
    filled = [r.i for r in mean.collect()]
    assert 2 in filled  # 7/3 truncated to 2
    med, surrogates = B.impute_exact_median(df)
    assert surrogates["d"] == 1.0  # {1.0, 3.0} -> lower middle, NaN counted as missing
    assert all(not math.isnan(r.d) for r in med.collect())


def test_impute_all_null_column_fails(spark):
    df = spark.createDataFrame([(None,), (None,)], "d double")
    with pytest.raises(Exception):
        B.impute_exact_median(df)


def test_count_nulls_nan(spark):
    df = spark.createDataFrame([(float("nan"), None), (None, "a"), (1.0, "b")], "d double, s string")
    plain = D.count_nulls(df).first()
    nan = D.count_nulls(df, nan_as_null=True).first()
    assert (plain.d, plain.s, nan.d, nan.s) == (1, 1, 2, 1)


def test_split_by_value_null_group(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "id int, g string")
    parts = {v: sorted(r.id for r in d.collect()) for v, d in B.split_by_value(df, "g")}
    assert parts == {"a": [1, 3], None: [2]}
    with pytest.raises(ValueError):
        B.split_by_value(spark.range(5), "id", max_groups=3)


def test_row_to_array_and_keep_columns(spark):
    df = spark.createDataFrame([(1, None, 2.0, 3)], "id int, a double, b double, c int")
    assert B.row_to_array(df, ["a", "b", "c"], keep=["id"]).first()["values"] == [2.0, 3.0]
    assert B.keep_columns(df, ["c", "a", "zzz"]).columns == ["a", "c"]
    assert B.drop_columns(df, "a", "zzz").columns == ["id", "b", "c"]


def test_add_random_col_is_binary(spark):
    vals = {r.r for r in B.add_random_col(spark.range(200), "r").collect()}
    assert vals == {0, 1}


def test_get_or_train_uses_stored_model(spark, tmp_out):
    from pyspark.ml.feature import VectorAssembler
    from flawscope.operators.clustering import kmeans_fit
    from flawscope.sources.models import get_or_train, load_kmeans, save_kmeans

    df = VectorAssembler(inputCols=["x"], outputCol="features").transform(
        spark.range(20).select(F.col("id").cast("double").alias("x")))
    calls = []

    def train():
        calls.append(1)
        return kmeans_fit(df, 2)

    first = get_or_train(spark, tmp_out, load_kmeans, train, save_kmeans)
    second = get_or_train(spark, tmp_out, load_kmeans, train, save_kmeans)
    assert len(calls) == 1
    assert sorted(map(list, first.clusterCenters())) == sorted(map(list, second.clusterCenters()))
