"""Comparison of a Spark result with DuckDB on the same Parquet tables."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as text, columns by name, in order."""

    def text(x) -> str:
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return "null"
        if isinstance(x, float) and x == int(x):
            return str(int(x))
        if isinstance(x, float):
            return f"{x:.6f}".replace("-0.000000", "0.000000")
        if hasattr(x, "isoformat"):
            return pd.Timestamp(x).isoformat()
        if hasattr(x, "__len__") and not isinstance(x, str):
            return "[" + ",".join(map(text, x)) + "]"
        return str(x)

    return sorted(tuple(text(x) for x in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False))


def differences(spark_df: pd.DataFrame, duck_df: pd.DataFrame) -> str:
    """Empty if both hold the same rows."""
    if sorted(spark_df.columns) != sorted(duck_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(duck_df.columns)}"
    a, b = canonical(spark_df), canonical(duck_df)
    if a == b:
        return ""
    only_a, only_b = sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3]
    return f"{len(a)} and {len(b)} rows; only in Spark {only_a}; only in DuckDB {only_b}"
