"""Compares a query with its SQL: same columns, same rows in any order."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(folder: str = DATA):
    con = duckdb.connect()
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        con.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def one(v):
    if pd.isna(v):
        return None
    return str(v) if isinstance(v, str) or not hasattr(v, "__float__") else round(float(v), 5)


def plain(df: pd.DataFrame) -> list:
    return sorted((tuple(map(one, row)) for row in df[sorted(df.columns)].itertuples(index=False)), key=repr)


def check(spark, query, sql: str, folder: str = DATA) -> None:
    got, want = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
