"""All queries of the library by name, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that DuckDB runs for the same rows."""

    def add(f):
        assert name not in _QUERIES, name
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    import importlib

    for part in ("verification", "statistics", "scalars", "collocation", "sequences", "grids", "catalogues", "profiles", "sampling", "formats", "matching", "retrieval", "files", "scenes", "presets"):
        importlib.import_module(f"orbitframe.plans.{part}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
