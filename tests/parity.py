"""Compares a Spark result with DuckDB's, columns by name, rows in any order."""

import math

import duckdb

from quern.session import TABLES


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def value(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        x = float(x)
        return None if math.isnan(x) else round(x, 6)
    return str(x)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted([tuple(value(r[c]) for c in names) for r in df.collect()], key=repr)


def duck_rows(con, sql):
    found = con.sql(sql)
    names = sorted(found.columns)
    place = [found.columns.index(c) for c in names]
    return names, sorted([tuple(value(r[i]) for i in place) for r in found.fetchall()], key=repr)
