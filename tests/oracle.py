"""Comparison of a query's rows with those of its SQL."""

from __future__ import annotations

import math
from pathlib import Path
from typing import Any

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if path.is_dir() else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v: Any) -> Any:
    if v is None or v is pd.NaT or v is pd.NA:
        return ""
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "dtype") and v.dtype.kind == "b":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return "" if math.isnan(float(v)) else f"{round(float(v), 5) + 0.0:.5f}"
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[Any, ...]]:
    names = sorted(df.columns)
    return sorted(tuple(map(_plain, r)) for r in df[names].astype(object).itertuples(index=False))
