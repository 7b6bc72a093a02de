"""Queries of the entry against their SQL in DuckDB."""

import math
import os
from collections import Counter
from pathlib import Path

import duckdb

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata")) / "sf0.001"


def connect():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p / '*.parquet' if p.is_dir() else p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else str(v)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def assert_same(spark, f, sql):
    df = f(spark, str(DATA))
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect())
    rel = connect().execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    want = Counter(tuple(plain(r[names.index(c)]) for c in columns) for r in rel.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
