"""Run a registered query and its SQL counterpart on the same tables and compare all rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(spark, con, query, sql: str, sf_dir: str) -> list:
    """Rows found on one side only (up to 5), or the differing column lists."""
    left = query(spark, sf_dir)
    right = con.execute(sql)
    names = [d[0] for d in right.description]
    if sorted(left.columns) != sorted(names):
        return [("columns", sorted(left.columns), sorted(names))]
    a, b = rows_of(left.columns, left.collect()), rows_of(names, right.fetchall())
    if a == b:
        return [] if a else [("empty", 0, 0)]
    only = sorted(set(a) ^ set(b))
    return [("rows", len(a), len(b)), *only[:5]]
