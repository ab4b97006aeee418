"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value) -> str:
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(map(plain, value)) + "]"
    return str(value)


def rows_of(columns: list[str], rows: list) -> list[tuple[str, ...]]:
    order = sorted(columns)
    at = [columns.index(c) for c in order]
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], list]:
    con = duckdb.connect()
    for name in TABLES:
        if Path(f"{sf_dir}/{name}.parquet").exists():
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def check(spark, query, sql: str, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    columns, rows = duck_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    own, other = rows_of(df.columns, df.collect()), rows_of(columns, rows)
    assert len(own) == len(other)
    assert [(a, b) for a, b in zip(own, other, strict=True) if a != b][:3] == []
