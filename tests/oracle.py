"""Compares a Spark result with DuckDB's on the same tables, row order and column order aside."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def text(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and pd.isna(x)):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else f"{x:.6g}"
    return str(x).replace("+00:00", "")


def canon(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        out[c] = out[c].map(text)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def assert_same(spark_df, sql: str, sf_dir: str) -> int:
    ours, theirs = canon(spark_df.toPandas()), canon(duck(sf_dir).sql(sql).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False)
    return len(ours)
