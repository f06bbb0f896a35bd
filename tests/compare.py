"""Rows of a query against its SQL in DuckDB, column by column."""

import glob
import os

import duckdb


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return int(v) if isinstance(v, bool) else v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())


def spark_rows(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])
