"""Compares a query with its SQL as the driver does: sorted columns, order-free rows."""

import glob
import math
import os

import duckdb
import pandas as pd


def connect(folder):
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return float(f"{v:.10g}")
    return v if isinstance(v, (bool, str)) else str(pd.Timestamp(v))


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted([tuple(map(value, r)) for r in df.itertuples(index=False)], key=repr)
