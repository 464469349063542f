"""Rows of a query and of its SQL, made comparable."""

import math
from pathlib import Path

import duckdb


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.6g}" if not math.isinf(float(value)) else "inf"
    return str(list(value)) if isinstance(value, (list, tuple)) else str(value)


def sql_rows(sf, sql):
    with duckdb.connect() as con:
        con.sql("SET TimeZone = 'UTC'")
        for f in Path(sf).glob("*.parquet"):
            con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
        got = con.sql(sql)
        names = sorted(got.columns)
        return names, sorted(tuple(plain(r[got.columns.index(n)]) for n in names) for r in got.fetchall())


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
