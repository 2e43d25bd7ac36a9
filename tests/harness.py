"""Runs a query in Spark and its SQL twin in DuckDB and compares the rows."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

DATA = os.environ.get("ROOKERY_TESTDATA", "/root/testdata")


def connect(folder: str):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        if f.endswith(".parquet"):
            p = os.path.join(folder, f)
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return c


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if type(v).__name__ == "Decimal":
        return norm(float(v)) if v != int(v) else int(v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, folder):
    df = query(spark, folder)
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    b = rows_of([d[0] for d in res.description], res.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} against {b[0]}"
    if a[1] != b[1]:
        return f"rows {sum(a[1].values())} against {sum(b[1].values())}: only Spark {list((a[1] - b[1]).items())[:4]}, only SQL {list((b[1] - a[1]).items())[:4]}"
    return ""
