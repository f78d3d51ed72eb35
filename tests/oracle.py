"""Comparison of a query's rows with DuckDB's."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype == bool:
        return bool(value)
    if isinstance(value, int) or type(value).__name__.startswith(("int", "uint")):
        return int(value)
    if isinstance(value, float) or type(value).__name__ in ("Decimal", "float32", "float64"):
        return round(float(value), 6) + 0.0
    return str(value)


def table_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple(str(x) for x in r))


def compare(name: str, df, con, sql: str) -> str:
    """Empty if the rows are equal, else what differs."""
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = table_of(names, result.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} and {len(want)} rows"
    for a, b in zip(got, want, strict=True):
        if a != b:
            return f"{name}: {a} and {b}"
    return "" if want else f"{name}: no rows to compare"
