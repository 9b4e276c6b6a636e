"""Run named queries in Spark and their SQL in DuckDB and compare the rows.

    python tests/compare.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("panelfill")
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.driver.memory", "12g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v) -> str:
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "dtype"):
        return repr(float(v)) if not isinstance(v, bool) else str(v)
    return str(v)


def canonical(pdf: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(pdf.columns)
    out = pd.DataFrame({c: [_cell(v) for v in pdf[c].astype(object).tolist()] for c in cols}, columns=cols)
    return out.sort_values(cols).reset_index(drop=True)


def differences(spark_pdf: pd.DataFrame, duck_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} vs {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"{len(spark_pdf)} rows vs {len(duck_pdf)}"
    a, b = canonical(spark_pdf), canonical(duck_pdf)
    bad = (a != b).any(axis=1)
    if not bad.any():
        return None
    i = bad[bad].index[0]
    return f"{int(bad.sum())} of {len(a)} rows differ, first:\n   spark {a.loc[i].to_dict()}\n   sql   {b.loc[i].to_dict()}"


def check(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = pd.DataFrame([r.asDict() for r in df.collect()], columns=df.columns, dtype=object)
    t1 = time.time()
    if sql is None:
        return len(rows), t1 - t0, 0.0, None if len(rows) else "no rows"
    cur = con.execute(sql)
    other = pd.DataFrame(cur.fetchall(), columns=[d[0] for d in cur.description], dtype=object)
    return len(rows), t1 - t0, time.time() - t1, differences(rows, other)


def main() -> None:
    import __spark_entry__ as e
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default=SF)
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    spark, con = session(), duck(args.sf)
    oracles, bad = e.oracle_sql(), []
    for name, fn in e.queries().items():
        if args.names and name not in args.names:
            continue
        try:
            n, ts, td, diff = check(spark, con, name, fn, oracles.get(name), args.sf)
        except Exception as exc:  # report and go on with the next query
            n, ts, td, diff = 0, 0.0, 0.0, f"{type(exc).__name__}: {str(exc)[:700]}"
        mark = "ok  " if diff is None else "BAD "
        kind = "" if name in oracles else " (rows only)"
        print(f"{mark}{name}: {n} rows, spark {ts:.1f}s, sql {td:.1f}s{kind}", flush=True)
        if diff:
            bad.append(name)
            print("   ", diff, flush=True)
    print("failed:", bad or "none")


if __name__ == "__main__":
    main()
