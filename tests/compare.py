"""A query against its oracle SQL, order-insensitive, floats rounded."""

from __future__ import annotations

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


def assert_same(df, sql: str, sf: str) -> None:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(v) for v in row) for row in result.fetchall()), key=repr)
    got = sorted((tuple(norm(row[n]) for n in names) for row in df.collect()), key=repr)
    assert len(got) == len(want)
    assert got == want
