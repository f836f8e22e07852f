"""Holds a query against its SQL in DuckDB."""

import math
import os

import duckdb


def connect(folder):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{f}'")
    return con


def norm(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(norm(y) for y in x)
    return tuple(sorted((k, norm(v)) for k, v in x.items())) if isinstance(x, dict) else x


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def sql_rows(con, sql):
    rel = con.sql(sql)
    cols = sorted(rel.columns)
    return cols, sorted((tuple(norm(x) for x in r) for r in con.sql(f"SELECT {', '.join(cols)} FROM ({sql})").fetchall()), key=repr)
