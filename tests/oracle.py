"""Compares a query with its SQL, rows in any order."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb


def _plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 2**40 else str(v)
    if isinstance(v, (list, tuple)):
        return str([_plain(x) for x in v])
    return str(v)


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def sql_rows(sql, sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted(tuple(_plain(row[i]) for i in at) for row in r.fetchall())
