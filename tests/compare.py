"""Runs a query in Spark and its SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4; SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return str(x)[:23].rstrip("0").rstrip(".")
    if isinstance(x, float):
        return round(x, 6) + 0.0
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str), [columns[i] for i in order]


def differences(spark_df, con, sql: str):
    """None if equal, or a few words on the first difference."""
    mine, names = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    found = con.execute(sql)
    theirs, other = rows_of([c[0] for c in found.description], found.fetchall())
    if names != other:
        return f"columns {names} and {other}"
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs, strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
