"""Compare a query with its SQL: row count, column names, values without regard to order."""

import glob
import os
from collections import Counter

import duckdb
import pandas as pd


def database(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def shown(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
        return "null"
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return repr(v) if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return Counter(tuple(map(shown, r)) for r in frame.itertuples(index=False, name=None))


def same(spark, folder, query, sql):
    got, want = query(spark, folder).toPandas(), database(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert a == b, f"only in the query: {list((a - b))[:3]}; only in SQL: {list((b - a))[:3]}"
