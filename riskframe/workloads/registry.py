"""Registry of runnable queries, each with its ANSI-SQL equivalent where one exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under an inventory name; ``sql`` is its oracle."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from riskframe.workloads import changes, operations, privacy, risk, similarity, storage, text  # noqa: F401
