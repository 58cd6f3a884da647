"""Compare a query with its SQL: same columns, same rows in any order."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if glob.glob(path):
            path += "/*.parquet" if os.path.isdir(path) else ""
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return [plain(y) for y in x]
    if isinstance(x, dict):
        return {k: plain(v) for k, v in x.items()}
    return x


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, as text; empty if nothing."""
    con = connect(sf_dir)
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    order = sorted(names)
    mine = [[plain(r[c]) for c in order] for r in df.collect()]
    theirs = [[plain(r[names.index(c)]) for c in order] for r in theirs]
    if len(mine) != len(theirs):
        return [f"{len(mine)} and {len(theirs)} rows"]
    a, b = sorted(mine, key=repr), sorted(theirs, key=repr)
    return [f"{x} and {y}" for x, y in zip(a, b, strict=True) if x != y][:5]
