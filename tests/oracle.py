"""Compares a query with SQL run by another engine over the same files."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def same_rows(spark, data, query, sql) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    df = query(spark, data)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=str)
    out = con.execute(sql)
    have = [c[0] for c in out.description]
    assert sorted(have) == names
    at = [have.index(c) for c in names]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in out.fetchall()), key=str)
