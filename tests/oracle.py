"""Holds a query's rows against its SQL in DuckDB, as sorted rows of rounded values."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("SKEIN_TEST_DATA", "/root/testdata/sf0.001")


def connection(data=DATA):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.7g}"
    return str(v)


def rows_of(df, columns):
    return sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())


def rows_of_sql(con, sql, columns):
    found = con.sql(sql)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    return sorted(tuple(plain(r[k]) for k in places) for r in found.fetchall())
