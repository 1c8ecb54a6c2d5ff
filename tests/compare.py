"""Compares a query with its SQL in DuckDB: columns, row counts and values in any order."""

import os

import duckdb
import pandas as pd


def frames(df, sql, d):
    con = duckdb.connect()
    for name in os.listdir(d):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{d}/{name}'")
    a, b = df.toPandas(), con.sql(sql).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns), (cols, sorted(b.columns))
    text = lambda f: f[cols].apply(lambda c: c.map(lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x))).sort_values(cols).reset_index(drop=True)
    return text(a), text(b)


def problem(df, sql, d):
    a, b = frames(df, sql, d)
    if len(a) != len(b):
        return f"{len(a)} rows, {len(b)} by SQL"
    bad = [c for c in a.columns if not a[c].equals(b[c])]
    return f"{bad}: {[(a[c][a[c] != b[c]].head(2).tolist(), b[c][a[c] != b[c]].head(2).tolist()) for c in bad[:2]]}" if bad else ""
