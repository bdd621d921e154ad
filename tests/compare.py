"""Compare a Spark result with DuckDB's, as sets of rows with multiplicity."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{directory}/{name}.parquet'")
    return con


def executed_plan(df) -> str:
    """The plan a frame was run with, after adaptive execution; runs it if need be."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    if "isFinalPlan=false" in plan:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0]


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return float(f"{value:.12g}") + 0.0
    return value


def _rows(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, con, sql: str) -> str | None:
    """None when columns, row count and values agree; else a short description."""
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    wanted = _rows(names, cursor.fetchall())
    found = _rows(df.columns, [tuple(r) for r in df.collect()])
    if found == wanted:
        return None
    only_found = list((found - wanted).items())[:3]
    only_wanted = list((wanted - found).items())[:3]
    return (
        f"{sum(found.values())} rows against {sum(wanted.values())}; "
        f"only Spark {only_found}; only SQL {only_wanted}"
    )
