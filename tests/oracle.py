"""Compare a query's rows with those of its SQL."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pandas as pd


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        return round(float(v), 6)
    if hasattr(v, "isoformat"):
        return v.isoformat()[:10]
    return v


def rows(df: pd.DataFrame):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_value(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)


def sql_rows(folder: str, sql: str):
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return rows(c.execute(sql).df())
