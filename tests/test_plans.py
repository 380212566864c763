"""Physical plans: no nested loops, pushed filters, pruned columns, early group limits."""

import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not there")


def plan(spark, name):
    return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "regex_theta_join", "map_conditions", "cross_param", "equi_plus_date_range_join", "reconcile_outcomes",
    "onset_after_progression", "kaplan_meier", "inpatient_cost", "op_all_classes", "markov_project", "open_cohort_cost",
])
def test_no_nested_loops(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_window_filter_reaches_the_scan(spark):
    text = plan(spark, "membership_filter")
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in text


def test_only_needed_columns_are_read(spark):
    text = plan(spark, "still_active_keys")
    for column in ("l_extendedprice", "l_discount", "o_totalprice", "p_retailprice"):
        assert column not in text


@pytest.mark.parametrize("name", ["first_per_key", "index_event", "first_of_each_condition"])
def test_rank_filters_limit_groups_before_the_shuffle(spark, name):
    assert plan(spark, name).count("WindowGroupLimit") >= 2
