"""Runs registered queries against their SQL in DuckDB and compares rows."""

from __future__ import annotations

import math
import os

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v + 0.0, 9)
    return v


def rows_of(columns: list[str], rows: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, query, sql: str, sf: str) -> str | None:
    df = query(spark, sf)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        extra, missing = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        return f"{len(got)} and {len(want)} rows; only here {len(extra)} {extra[:3]}; only in SQL {len(missing)} {missing[:3]}"
    return None
