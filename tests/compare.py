"""Comparison of a Spark result with its SQL in DuckDB: column names, row count and values, whatever the order."""

import os

import duckdb
import numpy as np
import pandas as pd


def connect(data: str):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in sorted(os.listdir(data)):
        at = f"{data}/{name}"
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{at}{'/*' if os.path.isdir(at) else ''}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return "NULL"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating, int, np.integer)):
        r = round(float(v), 9) + 0.0
        return repr(int(r)) if r == int(r) else repr(r)
    if isinstance(v, (list, tuple, np.ndarray)):
        return repr([plain(x) for x in v])
    return str(v)


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object)
    return sorted(tuple(plain(v) for v in r) for r in df.itertuples(index=False))


def same(spark_df, con, sql: str) -> None:
    a, b = spark_df.toPandas(), con.execute(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    ra, rb = rows(a), rows(b)
    assert len(ra) == len(rb)
    assert ra == rb, [(x, y) for x, y in zip(ra, rb) if x != y][:3]
