"""Runs a query and its SQL on the same tables and compares rows."""

import math
from collections import Counter
from datetime import datetime

import duckdb

from tessel.sources.tables import TABLES


def connect(folder):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return str([plain(x) for x in v])
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(repr([plain(r[i]) for i in order]) for r in values)


def assert_same(df, connection, sql):
    got = connection.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    want, have = rows(names, got.fetchall()), rows(df.columns, [tuple(r) for r in df.collect()])
    assert have == want, (list((have - want).items())[:3], list((want - have).items())[:3])
