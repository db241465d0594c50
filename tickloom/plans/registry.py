"""Name -> query and name -> SQL, filled by the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def q6(expr: str) -> str:
    """SQL twin of ``functions.numeric.r6``."""
    return f"(round_even(CAST({expr} AS DOUBLE) * 1e6 + 1e-4, 0) / 1e6 + 0.0)"
