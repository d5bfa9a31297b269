"""Queries by name, with the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under name, with DuckDB SQL that gives the same rows."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    load()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    load()
    return ORACLES


def load() -> None:
    """Import the modules that register queries."""
    from . import agreement, answers, files, joins, judging, parsing, reports, retrieval, windows  # noqa: F401
