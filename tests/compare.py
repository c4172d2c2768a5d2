"""Runs registered queries and their SQL over the same tables and compares the rows."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    return str(v) if v is not None and not isinstance(v, (int, bool, str, list)) else v


def rows_of(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(repr([plain(r[i]) for i in order]) for r in rows)


def differences(spark, con, sf_dir: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_names, want = rows_of(rel.columns, rel.fetchall())
    if names != want_names:
        return f"columns {names} and {want_names}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want))[:3]}; only there {list((want - got))[:3]}"
    return None
