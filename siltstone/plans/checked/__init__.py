"""Registered queries over the given tables, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_MODULES = ("files", "parsing", "graphs", "candidates", "lookups", "integrity")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its check SQL."""

    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and check SQL."""
    for module in _MODULES:
        import_module(f"{__name__}.{module}")
    return QUERIES, ORACLES
