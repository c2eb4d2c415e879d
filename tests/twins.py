"""Comparing a query's rows with those that DuckDB gives for its SQL twin."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TESTDATA = Path("/root/testdata")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """A connection with every table of sf_dir as a view."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for file in Path(sf_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return connection


def plain(value):
    """A value in the form in which both engines are compared; doubles to ten digits."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}") + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return bytes(value) if isinstance(value, bytearray) else value


def bag(rows, names: list[str]) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(df, sql: str, sf_dir: str) -> str:
    """What differs between df and the SQL twin's rows; "" if nothing does."""
    found = duck(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours, theirs = bag(df.collect(), df.columns), bag(found.fetchall(), names)
    extra, lacking = ours - theirs, theirs - ours
    return f"{extra.total()} rows more, such as {list(extra)[:2]}; {lacking.total()} fewer, such as {list(lacking)[:2]}" if extra or lacking else ""
