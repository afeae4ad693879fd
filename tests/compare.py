"""Runs a query's SQL in DuckDB and compares rows without regard to order."""

import glob
import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(data=DATA):
    c = duckdb.connect()
    for path in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def norm(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.6g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(columns)
    return sorted(tuple(norm(r[columns.index(c)]) for c in order) for r in rows)


def check(df, sql, connection):
    got = connection.execute(sql)
    columns = [x[0] for x in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, got.fetchall())
