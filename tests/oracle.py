"""Spark's rows against DuckDB's, as bags of rows by column name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    return x


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'; SET memory_limit = '8GB'; SET max_temp_directory_size = '1GB'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}{'/*' if p.is_dir() else ''}')")
    got = con.execute(sql)
    return bag([c[0] for c in got.description], got.fetchall())


def spark_bag(df):
    return bag(df.columns, [tuple(r) for r in df.collect()])
