"""What lies on disk while a query runs: the largest table is joined once, and finished stages leave no shuffle files."""

import os
import time

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lifeledger.operators import cohort
from lifeledger.plans.roles import Tables
from lifeledger.session import store

SMALL = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables are not there")

QUERIES = ["total_cost", "aft_fit_saturated", "survival_grid_saturated"]


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in dirs for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def test_a_stored_stage_leaves_no_shuffle_files(spark):
    df = spark.range(20_000).groupBy((F.col("id") % 997).alias("k")).agg(F.sum("id").alias("s"))
    before = shuffle_files(spark)
    stored = store(df)
    # The plan of ``df`` is still there, so no garbage collection could have taken them.
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.2)
    assert not left
    assert stored.count() == 997 == df.count()


@needs_tables
@pytest.mark.parametrize("name", QUERIES)
def test_the_largest_table_is_read_once(spark, monkeypatch, name):
    rows = spark.sparkContext.accumulator(0)
    read = Tables.read

    def counted(self, table):
        df = read(self, table)
        if table != "lineitem":
            return df

        def count(parts):
            for part in parts:
                rows.add(len(part))
                yield part

        return df.mapInPandas(count, df.schema)

    monkeypatch.setattr(Tables, "read", counted)
    assert entry.queries()[name](spark, SMALL).count() > 0
    assert rows.value == read(Tables(spark, SMALL), "lineitem").count()


@needs_tables
@pytest.mark.parametrize("role", ["diagnoses", "outpatient_dx", "ed_visits", "ward_stays", "prescriptions", "services"])
def test_roles_of_saved_lines_are_the_same(spark, role):
    tables = Tables(spark, SMALL)
    own, saved = getattr(tables, role), getattr(tables.prepared, role)
    assert own.dtypes == saved.dtypes
    assert own.count() > 0 and own.exceptAll(saved).count() == 0 and saved.exceptAll(own).count() == 0


def test_records_without_a_condition_go_first_and_change_nothing(spark, monkeypatch):
    codes = [(i % 7, f"{'AB'[i % 2]}{i % 11}", f"2020-01-{1 + i % 28:02d}") for i in range(300)] + [(1, None, "2020-01-01")]
    events = spark.createDataFrame(codes, "entity_id int, code string, d string").select("entity_id", "code", F.to_date("d").alias("event_date"))
    table = spark.createDataFrame([("A[135]$", "one", "Somatic"), ("A3|A10", "two", "Mental")], "pattern string, name string, type string")
    got = cohort.first_conditions(events, table)
    assert "LeftSemi" in got._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(cohort, "SENT_CODES", 0)
    plain = cohort.first_conditions(events, table)
    assert "LeftSemi" not in plain._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, plain.collect())) and got.count() > 0
