"""Runs a query's SQL oracle in DuckDB over the same tables and compares whole results (tests, bench)."""

from __future__ import annotations

import glob
import math
import os

from pyspark.sql import DataFrame


def oracle_rows(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{files}')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return [_plain(x) for x in value] if isinstance(value, list) else value


def canonical(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def same_rows(df: DataFrame, sql: str, sf_dir: str) -> bool:
    """Whether both give the same multiset of rows under the same column names; raises with an example if not."""
    names, want = oracle_rows(sql, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        raise AssertionError(f"columns {sorted(df.columns)} against {sorted(names)}")
    a, b = canonical(df.columns, got), canonical(names, want)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), (len(a), len(b)))
        raise AssertionError(f"{len(a)} rows against {len(b)}; first difference: {odd}")
    return True
