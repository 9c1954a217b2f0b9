"""Compare a query's rows with those of its DuckDB SQL."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if pd.api.types.is_scalar(v) and pd.isna(v):
        return "null"
    return f"{v:.6g}" if isinstance(v, float) else str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))


def by_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        for p in glob.glob(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con.execute(sql).df()


def assert_same(frame, sql, sf_dir):
    columns, left = rows(frame)
    other, right = rows(by_sql(sql, sf_dir))
    assert columns == other
    assert left == right
