"""Runs registered queries against their SQL on DuckDB: rows, columns, values."""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(partitions: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").appName("pluvia-tests")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if pd.api.types.is_numeric_dtype(df[c]):
            df[c] = df[c].astype("float64")
        else:
            df[c] = df[c].astype("object").where(df[c].notna(), None)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = canonical(got), canonical(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, e.g. {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    return ""


def main() -> int:
    import __spark_entry__ as entry

    parser = argparse.ArgumentParser()
    parser.add_argument("prefixes", nargs="*")
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--sql-only", action="store_true")
    args = parser.parse_args()
    spark, con = session(), duck(args.sf)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, plan in queries.items():
        if args.prefixes and not any(name.startswith(p) for p in args.prefixes):
            continue
        if args.sql_only and name not in sql:
            continue
        start = time.time()
        try:
            got = plan(spark, args.sf).toPandas()
            spent = time.time() - start
            if name in sql:
                mid = time.time()
                note = difference(got, con.execute(sql[name]).df())
                sql_spent = time.time() - mid
            else:
                note, sql_spent = "", 0.0
            state = "FAIL" if note else ("ok" if name in sql else "rows")
        except Exception as e:  # noqa: BLE001 - report every query
            note, spent, sql_spent, state, got = f"{type(e).__name__}: {str(e)[:900]}", 0, 0, "ERROR", []
        bad += state in ("FAIL", "ERROR")
        print(f"{state:5} {name:34} {len(got):8d} rows {spent:6.1f}s sql {sql_spent:5.1f}s {note}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
