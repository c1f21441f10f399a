"""Compares a query's rows with those of its SQL in DuckDB."""

import math
import os

import duckdb

FOLDER = "/root/testdata/sf0.001"


def database(folder=FOLDER):
    c = duckdb.connect()
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 8)
    return tuple(plain(x) for x in v) if isinstance(v, list) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)


def rows_of_sql(c, sql):
    relation = c.sql(sql)
    names = sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in relation.fetchall()), key=str)
