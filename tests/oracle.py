"""Run a query on Spark and its SQL check on DuckDB, and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    connection = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, [tuple(_plain(row[c]) for c in columns) for row in df.collect()]


def duck_rows(connection, sql: str):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_plain(r[i]) for i in order) for r in cursor.fetchall()]
    return sorted(names), rows


def _key(row):
    return tuple((v is not None, round(v, 6) if isinstance(v, float) else v) if not isinstance(v, bool)
                 else (True, int(v)) for v in row)


def difference(df, connection, sql: str) -> str | None:
    """None when equal, else what differs first. Kinds of values must agree, too."""
    columns, left = spark_rows(df)
    names, right = duck_rows(connection, sql)
    if columns != names:
        return f"columns {columns} != {names}"
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(sorted(left, key=_key), sorted(right, key=_key)):
        for name, x, y in zip(columns, a, b):
            if x is None and y is None:
                continue
            if type(x) is not type(y):
                return f"{name}: {x!r} ({type(x).__name__}) != {y!r} ({type(y).__name__})"
            if x != y:
                return f"{name}: {x!r} != {y!r}"
    return None
