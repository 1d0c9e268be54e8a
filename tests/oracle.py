"""Runs a query and its SQL twin and compares them, as rows without order."""

import decimal
import glob
import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def compare(df, sql, connection):
    columns = sorted(df.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
    assert ours == theirs
