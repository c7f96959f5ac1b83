"""Compare a Spark result with DuckDB on the same Parquet files, row by row."""

from __future__ import annotations

import math
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        connection.execute(
            f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')"
        )
    return connection


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, (int, float)):
        number = float(value)
        return "NaN" if math.isnan(number) else repr(number)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return datetime(value.year, value.month, value.day).isoformat()
    return str(value)


def canonical(columns, rows):
    """Rows as sorted tuples of plain values, columns in name order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def oracle_rows(connection, sql):
    cursor = connection.execute(sql)
    columns = [entry[0] for entry in cursor.description]
    types = {entry[0]: str(entry[1]) for entry in cursor.description}
    return columns, types, cursor.fetchall()


def differences(query_rows, oracle):
    """Readable differences between two canonical results; empty when equal."""
    columns, mine = query_rows
    their_columns, theirs = oracle
    if columns != their_columns:
        return [f"columns {columns} != {their_columns}"]
    found = []
    if len(mine) != len(theirs):
        found.append(f"{len(mine)} rows != {len(theirs)}")
    left, right = set(mine), set(theirs)
    found += [f"only spark: {row}" for row in sorted(left - right, key=repr)[:3]]
    found += [f"only duckdb: {row}" for row in sorted(right - left, key=repr)[:3]]
    if not found and mine != theirs:
        found.append("same rows, different multiplicities")
    return found
