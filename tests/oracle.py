"""Spark results against SQL in DuckDB."""

from __future__ import annotations

import decimal
import math
import os

DATA = "/root/testdata/sf0.001"


def connect():
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(DATA):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{DATA}/{t}'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=lambda z: tuple((x is None, str(x)) for x in z))


def same(spark, con, query, sql):
    cols, got = rows_of(query(spark, DATA))
    r = con.execute(sql)
    names = [x[0] for x in r.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(x[names.index(c)]) for c in cols) for x in r.fetchall()), key=lambda z: tuple((x is None, str(x)) for x in z))
    assert got == want
