"""Named queries over the driver's tables, each with the SQL that DuckDB checks it by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under name; sql gives the same rows in DuckDB."""

    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return add


def _load() -> None:
    from lexmill import plans  # noqa: F401  registers on import


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
