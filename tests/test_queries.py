"""Registered queries against DuckDB on the smallest tables. check_oracle.py runs all of them."""

import os

import pytest

import __spark_entry__ as entry
from tests.check_oracle import compare, connect

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not there")

CHOSEN = [
    "scan_merge", "scan_subset", "load_param_blocks", "regex_exclude", "any_column_match", "regex_theta_join",
    "existence_flag", "equi_plus_date_range_join", "first_per_key", "group_mean_sd_rate", "baseline_table",
    "completed_years", "parse_number", "first_of_each_condition", "reconcile_outcomes", "timeline_checks",
    "censored_base_progression", "kaplan_meier", "kaplan_meier_events", "events_by_stratum", "total_cost",
    "markov_project", "open_cohort_cost",
]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(spark, con, name):
    status, _, n = compare(spark, con, name, SMALL)
    assert status == "ok" and n > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).columns == ["age_band", "days", "n_risk", "n_event", "n_censor", "survival"]
