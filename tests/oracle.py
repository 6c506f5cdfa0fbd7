"""Compares a query with its SQL in DuckDB over the same Parquet tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or value is pd.NA or isinstance(value, float) and math.isnan(value):
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, list | tuple):
        return tuple(_plain(x) for x in value)
    if isinstance(value, bool):
        return value
    if isinstance(value, int | float):
        return float(f"{float(value):.9g}")
    return value


def rows(frame: pd.DataFrame) -> list[tuple]:
    names = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[names].astype(object).itertuples(index=False, name=None)), key=repr)


def compare(df, sql: str, sf_dir: str) -> None:
    mine, theirs = df.toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    a, b = rows(mine), rows(theirs)
    assert len(a) == len(b), f"{len(a)} rows, {len(b)} by SQL"
    wrong = [(x, y) for x, y in zip(a, b, strict=True) if x != y]
    assert not wrong, f"{len(wrong)} of {len(a)} rows differ, as {wrong[0]}"
