"""Run registered queries and compare each with its SQL in DuckDB.

Usage: python tests/check_oracle.py [--dir DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from lifeledger.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[str]:
    """Rows as sorted text, columns in name order; numbers keep ten significant digits."""

    def text(v) -> str:
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "-"
        if isinstance(v, bool):
            return str(v)
        if hasattr(v, "item"):
            v = v.item()
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return f"{float(v) + 0.0:.10g}"
        if hasattr(v, "isoformat"):
            return v.isoformat()[:10] if v.isoformat().endswith("00:00:00") else v.isoformat()
        return str(v)

    columns = sorted(df.columns)
    return sorted("|".join(text(v) for v in row) for row in df[columns].itertuples(index=False, name=None))


def compare(spark, con, name: str, sf_dir: str) -> tuple[str, float, int]:
    began = time.time()
    frame = entry.queries()[name](spark, sf_dir)
    got = pd.DataFrame([tuple(r) for r in frame.collect()], columns=frame.columns)
    took = time.time() - began
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return ("rows" if len(got) else "EMPTY"), took, len(got)
    result = con.execute(sql)
    want = pd.DataFrame(result.fetchall(), columns=[c[0] for c in result.description])
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} vs {sorted(want.columns)}", took, len(got)
    a, b = canonical(got), canonical(want)
    if a != b:
        extra, missing = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
        return f"DIFFER {len(a)} vs {len(b)} rows; only here {extra}; only SQL {missing}", took, len(got)
    return ("ok" if len(got) else "EMPTY"), took, len(got)


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--dir", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(args.dir), 0
    for name in args.names or list(entry.queries()):
        try:
            status, took, n = compare(spark, con, name, args.dir)
        except Exception as error:
            status, took, n = f"ERROR {type(error).__name__}: {str(error)[:600]}", 0.0, 0
            if args.names:
                traceback.print_exc()
        bad += status not in ("ok", "rows")
        print(f"{name:32s} {took:6.2f}s {n:8d} {status}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(main())
