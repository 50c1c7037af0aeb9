"""Runs queries against their SQL in DuckDB on the same tables."""

import os

import duckdb
import pandas as pd


def connection(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else f"{sf_dir}/{f}"
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns), ignore_index=True, key=lambda c: c.astype(str) if c.dtype == object else c)


def differs(spark, con, sf_dir, query, sql) -> str:
    got = normal(query(spark, sf_dir).toPandas())
    want = normal(con.execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} and {list(want.columns)}"
    kinds = [(c, str(got[c].dtype), str(want[c].dtype)) for c in got if str(got[c].dtype) != str(want[c].dtype) and len(got) and not got[c].isna().any()]
    if kinds:
        return f"types {kinds}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for c in got:
        bad = ~((got[c] == want[c]) | (got[c].isna() & want[c].isna()))
        if bad.any():
            return f"{c}: {int(bad.sum())} of {len(got)} differ, as {got[c][bad].iloc[0]!r} and {want[c][bad].iloc[0]!r}"
    return ""
