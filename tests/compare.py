"""Runs a registered query on Spark and its SQL on DuckDB and compares the rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else float(f"{v:.12g}")
    return v


def as_bag(columns, rows) -> Counter:
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(normal(r[i]) for i in at) for r in rows)


def difference(spark_df, con, sql: str) -> str | None:
    got_cols = spark_df.columns
    got = as_bag(got_cols, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    want_cols = [c[0] for c in cur.description]
    want = as_bag(want_cols, cur.fetchall())
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} versus {sorted(want_cols)}"
    if got != want:
        only_got, only_want = got - want, want - got
        return (
            f"{sum(got.values())} versus {sum(want.values())} rows; columns {sorted(got_cols)}; "
            f"only spark {sum(only_got.values())}: {list(only_got)[:3]}; only sql {sum(only_want.values())}: {list(only_want)[:3]}"
        )
    return None
