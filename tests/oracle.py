"""Comparison of a query with its SQL in DuckDB on the same files."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def tidy(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or df[c].map(lambda x: hasattr(x, "isoformat")).any():
            df[c] = pd.to_datetime(df[c]).dt.strftime("%Y-%m-%d %H:%M:%S")
        elif df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else float(x) if not isinstance(x, (str, bytes, list, dict)) and not hasattr(x, "__len__") else str(list(x)) if hasattr(x, "__len__") and not isinstance(x, str) else x)
        else:
            df[c] = df[c].astype("float64") if not str(df[c].dtype).startswith("str") else df[c]
    return df.sort_values(list(df.columns), key=lambda s: s.map(lambda x: (x is None or x != x, str(x) if isinstance(x, str) else x if x == x and x is not None else 0)) if s.dtype == object else s).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str:
    """Empty where both hold the same rows, else what differs first."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    a, b = tidy(got), tidy(want)
    for c in a.columns:
        x, y = a[c], b[c]
        both_null = x.isna() & y.isna()
        same = both_null | ((x - y).abs() <= 2e-6 * (1 + y.abs()) if x.dtype == y.dtype == "float64" else x == y)
        if not same.all():
            i = (~same).idxmax()
            return f"column {c}, {int((~same).sum())} rows, first {a.loc[i].to_dict()} and {b.loc[i].to_dict()}"
    return ""
