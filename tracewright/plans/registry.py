"""Registered queries of the trajectory and rollout engine, by name, with their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("trajectories", "tables", "text", "tools", "scores", "metrics", "advantages", "arrays", "streams", "plugins", "rest")
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; ``sql`` is its twin for another engine."""

    def add(function: Query) -> Query:
        key = name or function.__name__
        _QUERIES[key] = function
        if sql:
            _SQL[key] = sql
        return function

    return add


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracewright.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
