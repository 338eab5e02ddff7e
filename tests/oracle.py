"""Comparison of a query with its SQL in DuckDB."""

import math
import os

import duckdb


def connect(folder):
    c = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return c


def _plain(v):
    if isinstance(v, float):
        return 0.0 if v == 0 else (round(v, 6) if math.isfinite(v) else str(v))
    return [_plain(x) for x in v] if isinstance(v, list) else v


def same_rows(df, con, sql):
    found = con.sql(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    ours = sorted(([_plain(r[c]) for c in order] for r in df.collect()), key=repr)
    theirs = sorted(([_plain(r[names.index(c)]) for c in order] for r in found.fetchall()), key=repr)
    assert ours == theirs
