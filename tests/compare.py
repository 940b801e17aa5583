"""Run a query in Spark and its SQL in DuckDB and compare rows and values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int,)):
        return ("n", float(value))
    if isinstance(value, float):
        return None if math.isnan(value) else ("n", value + 0.0)
    if isinstance(value, (list, tuple)):
        return ("l", tuple(_cell(v) for v in value))
    return ("s", str(value))


def _rows(names, rows):
    """Rows with columns by name; sorted by their exact cells first, then by their numbers."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    whole = lambda c: c is not None and c[0] == "n" and c[1] != int(c[1])
    floats = {i for i in range(len(order)) if any(whole(row[i]) for row in cells)}
    return sorted(cells, key=lambda row: repr([c for i, c in enumerate(row) if i not in floats] + [c for i, c in enumerate(row) if i in floats]))


def _same(a, b):
    """Equal cells; rounded numbers may differ by one step where the last bits straddle a rounding border."""
    if a == b:
        return True
    if a is None or b is None or a[0] != "n" or b[0] != "n":
        return False
    return abs(a[1] - b[1]) <= 1.1e-6 * max(1.0, abs(a[1]))


def compare(spark, connection, name, function, sql, sf_dir) -> str | None:
    """None when equal, else what differs."""
    df = function(spark, sf_dir)
    left = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    right = _rows(names, cursor.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} != {sorted(names)}"
    if len(left) != len(right):
        return f"{name}: {len(left)} rows != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if not all(map(_same, a, b))]
    if bad:
        return f"{name}: {len(bad)} of {len(left)} rows differ, first {bad[0]} (columns {sorted(names)})"
    return None
