"""Physical-plan checks: pruning / pushdown reach the scan, no single-partition bottleneck in
the distributed operators, no Python evaluation in the hot paths."""

import pytest

import __spark_entry__ as E
from conftest import SF_TINY


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def qs():
    return E.queries()


def test_projection_reaches_the_scan(spark, qs):
    plan = _plan(qs["keep_columns"](spark, SF_TINY))
    assert "struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_filter_pushed_into_member_scan(spark, qs):
    plan = _plan(qs["semi_join_cluster_members"](spark, SF_TINY))
    assert "EqualTo(o_orderstatus,F)" in plan
    assert "LeftSemi" in plan


@pytest.mark.parametrize("name", ["add_row_index", "positional_merge", "undersample_majority"])
def test_row_numbering_has_no_single_partition_step(spark, qs, name):
    df = qs[name](spark, SF_TINY)
    plan = _plan(df)
    assert "SinglePartition" not in plan
    assert "TakeOrderedAndProject" not in plan and "GlobalLimit" not in plan


@pytest.mark.parametrize("name", ["inertia", "nearest_center", "squared_distance", "project_fixed_loadings",
                                  "binary_conversion", "impute_mean", "flow_cluster_prepare", "count_nulls",
                                  "drop_constant_columns", "quantile_bins"])
def test_no_python_evaluation(spark, qs, name):
    plan = _plan(qs[name](spark, SF_TINY))
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_pivot_aggregates_map_side(spark, qs):
    plan = _plan(qs["binary_conversion"](spark, SF_TINY))
    assert "partial_max" in plan


def test_registry_names(qs):
    import re
    assert all(re.fullmatch(r"[a-z][a-z0-9_]*", n) for n in qs)
    assert set(E.oracle_sql()) <= set(qs)
