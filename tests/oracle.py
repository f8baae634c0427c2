"""Runs registered queries in Spark and their SQL in DuckDB and compares all rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb
from pyspark.sql import DataFrame


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return connection


def _plain(value: object) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "NULL"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return repr(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    return f"{type(value).__name__}:{value}"


def _sorted_rows(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(result: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[int, list[str]]:
    """Row count of the Spark result, and a list of differences."""
    answer = connection.execute(sql)
    names = [d[0] for d in answer.description]
    expected = _sorted_rows(names, answer.fetchall())
    got = _sorted_rows(result.columns, [tuple(r) for r in result.collect()])
    faults = []
    if sorted(names) != sorted(result.columns):
        faults.append(f"columns {sorted(result.columns)} / {sorted(names)}")
    if len(got) != len(expected):
        faults.append(f"{len(got)} rows / {len(expected)}")
    if not faults:
        faults += [f"{g} / {e}" for g, e in zip(got, expected) if g != e][:3]
    return len(got), faults
