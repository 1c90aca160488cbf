"""Runs a query in Spark and its SQL in DuckDB on the same tables and compares the rows."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 8)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)


def duck_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    order = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=repr)
