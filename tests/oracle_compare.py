"""Run a registered query in Spark and its oracle SQL in DuckDB; compare.

Comparison is order-insensitive: columns sorted by name, rows as a sorted
multiset, floats rounded to 6 decimals.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, f"{round(v, 6):.6f}")
    if isinstance(v, decimal.Decimal):
        return (1, f"{round(float(v), 6):.6f}")
    if isinstance(v, bool):
        return (2, str(v))
    if isinstance(v, int):
        return (1, f"{float(v):.6f}")
    if isinstance(v, (dt.date, dt.datetime)):
        return (3, v.isoformat())
    return (4, str(v))


def normalise(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted(tuple(_norm(r[i]) for i in order) for r in rows)
    return cols, out


def compare(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = fn(spark, sf_dir)
    s_cols, s_rows = normalise(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(sql)
    d_cols_raw = [d[0] for d in rel.description]
    d_cols, d_rows = normalise(d_cols_raw, rel.fetchall())
    if s_cols != d_cols:
        return False, f"{name}: columns differ\n spark={s_cols}\n duck ={d_cols}"
    if len(s_rows) != len(d_rows):
        return False, f"{name}: row count spark={len(s_rows)} duck={len(d_rows)}"
    if s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        return False, f"{name}: values differ, e.g. {diff}"
    return True, f"{name}: ok ({len(s_rows)} rows)"
