"""Run registered queries against their SQL counterparts."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
from pyspark.sql import DataFrame

TYPES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _rows(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return frame.map(lambda v: repr(v) if isinstance(v, float) else str(v)).sort_values(
        list(frame.columns)
    ).reset_index(drop=True)


def differences(result: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """None when columns, types and rows agree, otherwise what does not."""
    expected = con.sql(sql)
    types = {name: str(kind) for name, kind in zip(expected.columns, expected.types)}
    got_types = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in result.schema}
    if types != got_types:
        return f"types: spark {got_types} sql {types}"
    got, want = _rows(result.toPandas()), _rows(expected.df())
    if len(got) != len(want):
        return f"rows: spark {len(got)} sql {len(want)}"
    if len(got) and not got.equals(want):
        bad = (got != want).any(axis=1)
        return f"{bad.sum()} of {len(got)} rows differ, first:\n{got[bad].head(3)}\n{want[bad].head(3)}"
    return None
