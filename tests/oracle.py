"""Compare registered queries with their check SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return value if value is None or isinstance(value, (str, bool, int)) else str(value)


def rows(columns: list[str], values: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda at: columns[at])
    return sorted((tuple(_plain(row[at]) for at in order) for row in values), key=repr)


def differences(query, sql: str, spark, folder: str) -> list[str]:
    """Empty when both sides return the same columns and rows."""
    frame = query(spark, folder)
    ours = rows(frame.columns, [tuple(row) for row in frame.collect()])
    result = connect(folder).execute(sql)
    names = [column[0] for column in result.description]
    theirs = rows(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return [f"columns {sorted(frame.columns)} against {sorted(names)}"]
    kinds = {name: kind for name, kind in frame.dtypes}
    notes = [f"nested column {name}" for name, kind in kinds.items() if kind.startswith(("array", "struct", "map"))]
    if len(ours) != len(theirs):
        notes.append(f"{len(ours)} rows against {len(theirs)}")
    differing = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if differing:
        notes.append(f"{len(differing)} rows differ, first {differing[0]}")
    return notes
