"""Comparison of a query's rows with its SQL's."""

import datetime as dt
import math
import os

import pandas as pd


def run_sql(sql: str, d: str) -> pd.DataFrame:
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(d):
        if f.endswith(".parquet"):
            p = f"{d}/{f}"
            c.sql(f"create view {f[:-8]} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c.sql(sql).df()


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return ""
    if isinstance(x, (pd.Timestamp, dt.datetime)):
        return str(x)[:19] if (x.hour or x.minute or x.second) else str(x)[:10]
    if isinstance(x, float) or "float" in str(getattr(x, "dtype", "")):
        x = float(x)
        return "" if math.isnan(x) else f"{x + 0.0:.9g}"
    return str(x)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(cell(x) for x in r) for r in pdf[sorted(pdf.columns)].itertuples(index=False))
