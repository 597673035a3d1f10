"""Holds queries against their SQL on the same Parquet tables."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def canon(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.6g}"
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") else s
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in values)


def differences(spark, con, sf_dir, name, query, sql):
    """None if rows and columns agree, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.limit(10**9).fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"{name}: columns {df.columns} and {rel.columns}"
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return f"{name}: {len(got)} and {len(want)} rows; {len(a)} only in Spark {sorted(a)[:2]}; {len(b)} only in SQL {sorted(b)[:2]}"
    return None
