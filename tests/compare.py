"""Runs registered queries and their SQL over one scale factor and compares the rows."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(at):
            at += "/*.parquet"
        if glob.glob(at):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{at}')")
    return con


def plain(v: object) -> object:
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return ""
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        return f"{float(v):.9g}"
    return str(v)


def rows(columns: list[str], data: list) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def differ(spark, con, run, check: str, sf_dir: str = SF_DIR) -> str:  # noqa: ANN001
    """Empty if both agree, else what doesn't."""
    df = run(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(check)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    if got != want:
        a, b = [r for r in got if r not in set(want)][:2], [r for r in want if r not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; only ours {a}; only SQL's {b}"
    return "" if got else "no rows"
