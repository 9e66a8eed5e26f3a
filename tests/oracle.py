"""Compares a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb


def connection(folder: str):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


def differences(spark_df, con, sql: str) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(spark_df.columns):
        return [f"columns {sorted(spark_df.columns)} and {sorted(names)}"]
    a, b = rows_of(spark_df.columns, spark_df.collect()), rows_of(names, found.fetchall())
    if len(a) != len(b):
        return [f"{len(a)} rows and {len(b)}"] + [f"{x} | {y}" for x, y in zip(a[:3], b[:3])]
    return [f"{x} | {y}" for x, y in zip(a, b) if x != y][:5]
