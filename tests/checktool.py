"""Run registered queries in Spark and DuckDB and compare them: ``python tests/checktool.py [names]``."""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
SF_DIR = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.01")


def session():
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connection(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype).startswith(("str", "string")):
            df[c] = df[c].astype(object).where(df[c].notna(), None).map(lambda v: "~" if v is None else str(v))
        else:
            df[c] = df[c].astype("float64").map(lambda v: "~" if pd.isna(v) else repr(float(v)))
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns differ: {sorted(set(got.columns) ^ set(want.columns))}"
    if len(got) != len(want):
        return f"rows differ: {len(got)} and {len(want)}"
    a, b = canonical(got), canonical(want)
    if a.equals(b):
        return ""
    keys = [c for c in ("run_name", "ensemble", "score", "split", "symbol", "src", "dst", "date", "rank") if c in a]
    bad = {}
    for c in a.columns:
        n = int((a[c] != b[c]).sum())
        if n:
            i = (a[c] != b[c]).idxmax()
            bad[c] = (n, a[c][i], b[c][i], tuple(a.loc[i, keys]), tuple(b.loc[i, keys]))
    return f"values differ: {bad}"


def main(names: list[str]) -> int:
    from __spark_entry__ import oracle_sql, queries
    spark, con = session(), connection()
    qs, sqls = queries(), oracle_sql()
    failed = []
    for name in names or list(qs):
        t0 = time.time()
        try:
            got = qs[name](spark, SF_DIR).toPandas()
            t1 = time.time()
            if name not in sqls:
                print(f"rows  {name:26s} {len(got):7d} rows  spark {t1 - t0:5.1f}s", flush=True)
                continue
            want = con.execute(sqls[name]).df()
            problem = compare(got, want)
        except Exception as e:                                        # noqa: BLE001
            problem, got, t1 = f"{type(e).__name__}: {str(e)[:1200]}", [], time.time()
        print(f"{'ok   ' if not problem else 'FAIL '} {name:26s} {len(got):7d} rows  spark {t1 - t0:5.1f}s "
              f"duckdb {time.time() - t1:5.1f}s {problem[:1500]}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
