"""Rows of a Spark query against rows of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import numpy as np


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, np.generic):
        x = x.item()
    if isinstance(x, (list, np.ndarray)):
        return tuple(plain(v) for v in x)
    return round(float(x), 5) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(v[i]) for i in order) for v in values), key=repr)


def from_sql(sql, folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    got = con.execute(sql)
    return rows([d[0] for d in got.description], got.fetchall())


def from_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
