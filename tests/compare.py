"""Strict comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def differences(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Human-readable mismatches, empty when the results are equal."""
    rel = con.execute(sql)
    duck_columns = [d[0] for d in rel.description]
    expected = _rows(duck_columns, rel.fetchall())
    actual = _rows(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(duck_columns):
        return [f"columns {sorted(df.columns)} != {sorted(duck_columns)}"]
    if len(actual) != len(expected):
        return [f"rows {len(actual)} != {len(expected)}"]
    bad = [(a, e) for a, e in zip(actual, expected) if a != e]
    if not bad:
        return []
    names = sorted(df.columns)
    a, e = bad[0]
    cells = [f"{n}: {x!r} != {y!r}" for n, x, y in zip(names, a, e) if x != y]
    return [f"{len(bad)} rows differ; first: {cells[:6]}"]
