"""timeline_checks counts every progression, also those that the stand-in takes out for the fits."""

import os
from datetime import datetime

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from lifeledger.plans.roles import Tables
from tests.check_oracle import compare, connect

# Qualifying orders (date, price) per entity. Nobody has a relevant record, so all recover 180 days after entry
# unless they die first; an order above 350000 is a death.
ORDERS = {
    100: [("1996-02-01", 10.0), ("1996-03-01", 10.0), ("1996-04-01", 10.0)],
    101: [("1996-02-01", 10.0), ("1996-03-01", 10.0), ("1996-07-30", 10.0)],
    102: [("1996-02-01", 10.0), ("1996-03-01", 10.0), ("1999-12-01", 10.0)],
    103: [("1996-02-01", 10.0), ("1996-03-01", 10.0), ("1999-12-01", 400000.0)],
    104: [("1996-02-01", 10.0), ("1996-03-01", 10.0), ("1996-07-01", 400000.0)],
    105: [("1996-02-01", 10.0), ("1996-03-01", 10.0)],
}
LATE = {101, 102, 103}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("timeline")
    flat = [(k, datetime.fromisoformat(d), price) for k, rows in ORDERS.items() for d, price in rows]
    n = range(1, len(flat) + 1)
    tables = {
        "customer": {"c_custkey": list(ORDERS), "c_nationkey": 0},
        "orders": {
            "o_orderkey": n, "o_custkey": [k for k, _, _ in flat], "o_orderdate": [d for _, d, _ in flat],
            "o_totalprice": [p for _, _, p in flat], "o_orderpriority": "1-URGENT", "o_orderstatus": "O",
        },
        "lineitem": {
            "l_orderkey": n, "l_partkey": 1, "l_suppkey": 1, "l_linenumber": 1, "l_quantity": 1.0, "l_extendedprice": 1.0,
            "l_returnflag": "N", "l_linestatus": "O", "l_shipdate": [d for _, d, _ in flat],
        },
        "part": {"p_partkey": [1], "p_name": "plain", "p_brand": "Brand#50", "p_type": "STANDARD", "p_size": 1},
    }
    for name, columns in tables.items():
        df = pd.DataFrame(columns)
        for c in df.select_dtypes("datetime"):
            df[c] = df[c].astype("datetime64[us]")
        df.to_parquet(out / f"{name}.parquet")
    return str(out)


def test_every_progression_is_checked(spark, folder):
    got = {r["rule"]: r["violations"] for r in entry.queries()["timeline_checks"](spark, folder).collect()}
    assert len(got) == 14
    assert got.pop("progression_not_before_recovery") == len(LATE)
    assert set(got.values()) == {0}


def test_sql_counts_every_progression(folder):
    con = duckdb.connect()
    for name in ("customer", "orders", "lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    got = dict(con.execute(entry.oracle_sql()["timeline_checks"]).fetchall())
    assert got.pop("progression_not_before_recovery") == len(LATE)
    assert set(got.values()) == {0}


def test_fits_keep_progressions_in_order(spark, folder):
    tables = Tables(spark, folder)
    kept = {r["entity_id"] for r in tables.progression_dates.collect()}
    every = {r["entity_id"] for r in tables.third_records.collect()}
    assert kept == {100} and every == {100, 101, 102, 103, 104}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="benchmark tables are not there")
def test_violations_of_the_benchmark_tables(spark):
    sf_dir = "/root/testdata/sf0.01"
    status, _, n = compare(spark, connect(sf_dir), "timeline_checks", sf_dir)
    assert status == "ok" and n == 14
    found = entry.queries()["timeline_checks"](spark, sf_dir).where("violations > 0").collect()
    assert [tuple(r) for r in found] == [("progression_not_before_recovery", 35)]
