"""Compares a query's rows with its SQL in DuckDB."""

from __future__ import annotations

import math
from datetime import datetime
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path if path.is_file() else path / '*.parquet'}')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return value.isoformat() if isinstance(value, datetime) else value


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def of_spark(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(db, sql: str) -> tuple[list[str], list[tuple]]:
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return sorted(names), rows(names, found.fetchall())
