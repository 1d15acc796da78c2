"""Runs a registered query and its SQL side by side."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.10g}")
    return v


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str | None:
    """None where both agree, otherwise what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return f"{name}: columns {cols} vs {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())
    if not got and not want:
        return f"{name}: both are empty"
    if got != want:
        only_s = list((got - want).items())[:3]
        only_d = list((want - got).items())[:3]
        return f"{name}: {sum(got.values())} vs {sum(want.values())} rows; only spark {only_s}; only sql {only_d}"
    # Types must agree too.
    kinds = dict(zip(names, [str(d[1]) for d in cur.description]))
    loose = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}
    for c, t in df.dtypes:
        if loose.get(t) != kinds[c]:
            return f"{name}: column {c} is {t} vs {kinds[c]}"
    return None
