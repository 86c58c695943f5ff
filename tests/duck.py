"""Runs an oracle in DuckDB and compares it with a Spark result."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[: -len(".parquet")]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c.sql(sql).df()


def rows(df: pd.DataFrame) -> list[str]:
    def plain(x):
        if x is None or (not hasattr(x, "__len__") and pd.isna(x)):
            return None
        if isinstance(x, float):
            return int(x) if x == int(x) else round(x, 6)
        return x.item() if hasattr(x, "item") else x

    return sorted(str(tuple(plain(x) for x in r)) for r in df[sorted(df.columns)].itertuples(index=False))


def same(spark_df, sql: str, sf_dir: str) -> None:
    got, want = spark_df.toPandas(), oracle(sql, sf_dir)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
