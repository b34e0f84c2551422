"""Runs a query and its DuckDB statement on the same files and compares all rows."""

from __future__ import annotations

import glob
import os

import duckdb

from tidemark.sources.tables import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def _value(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    return str(int(x)) if isinstance(x, bool) else str(x)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in rows)


def differences(df, con, sql: str) -> list[str]:
    """What differs, in words; nothing if all is equal."""
    got = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    want = rows_of(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    if not want:
        return ["no rows"]
    if len(got) != len(want):
        return [f"{len(got)} rows and {len(want)}; first only here {sorted(set(got) - set(want))[:2]}, only there {sorted(set(want) - set(got))[:2]}"]
    return [f"{a} and {b}" for a, b in zip(got, want, strict=True) if a != b][:3]
