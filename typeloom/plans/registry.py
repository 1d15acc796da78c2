"""Named queries over the given tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .demo import SQL_VIEWS, DemoStore, open_store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def with_views(sql: str, ctes: str = "") -> str:
    """The SQL behind the demo views it names (and the views those name), as one statement."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b[vl]_[a-z]+\b", text):
            if name in SQL_VIEWS and name not in needed:
                need(SQL_VIEWS[name])
                needed.append(name)

    need(ctes + " " + sql)
    parts = [f"{n} AS ({SQL_VIEWS[n]})" for n in needed] + ([ctes.strip().rstrip(",")] if ctes.strip() else [])
    return (f"WITH RECURSIVE {', '.join(parts)} " if parts else "") + sql.strip()


def query(name: str, sql: str | None = None, ctes: str = "") -> Callable[[Callable[[DemoStore], DataFrame]], Query]:
    """Register a query on the demo store under ``name``."""

    def register(f: Callable[[DemoStore], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(open_store(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_views(sql, ctes)
        return run

    return register
