"""Holds queries against their oracle SQL as the driver does: rows, columns and values, in any order."""

from __future__ import annotations

import glob
import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        path = f"{path}/*.parquet" if os.path.isdir(path) else path
        if glob.glob(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)):
        return None
    if isinstance(v, np.ndarray):
        return tuple(_plain(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (float, np.floating)):
        return int(v) if float(v).is_integer() else float(v)
    if isinstance(v, (int, np.integer)) and not isinstance(v, bool):
        return int(v)
    if hasattr(v, "asDict"):
        return _plain(v.asDict())
    return v


def rows(frame: pd.DataFrame) -> list[tuple]:
    cols = sorted(frame.columns)
    return sorted((tuple(_plain(v) for v in r) for r in frame[cols].itertuples(index=False, name=None)), key=repr)


def differences(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    a, b = rows(spark_rows), rows(sql_rows)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; first only here {next((x for x in a if x not in set(b)), None)}, only there {next((x for x in b if x not in set(a)), None)}"
    for x, y in zip(a, b, strict=True):
        if x != y:
            n = sum(p != q for p, q in zip(a, b, strict=True))
            return f"{n} of {len(a)} rows differ, as {x} and {y}"
    return None
