"""Compares a query's rows with DuckDB's."""

import datetime
import math
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float | np.floating):
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, np.integer | np.bool_):
        return v.item()
    if isinstance(v, datetime.date | pd.Timestamp):
        return str(pd.Timestamp(v))
    return v


def rows(frame: pd.DataFrame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_value, r)) for r in frame.itertuples(index=False)), key=repr)


def duck(sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con.sql(sql).df()
