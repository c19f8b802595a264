"""Runs a query and its SQL on the same tables and tells how they differ."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return (0, "")
    if isinstance(x, bool):
        return (1, str(x))
    if isinstance(x, (int, float)):
        return (1, repr(round(float(x), 6)))
    return (1, str(x))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return [columns[k] for k in order], sorted([tuple(_cell(r[k]) for k in order) for r in rows])


def difference(spark, con, query, sql: str, sf_dir: str) -> str | None:
    df = query(spark, sf_dir)
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    theirs = rows_of(names, found.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} and {len(theirs[1])} rows"
    for a, b in zip(ours[1], theirs[1], strict=True):
        if a != b:
            return f"{a} and {b}"
    return None
