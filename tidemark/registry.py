"""All queries of the library but those of the subpackage llm."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}
_PLANS = ("intervals", "sequences", "evidence", "selection", "vectors", "texts", "changes", "kernels", "features", "rules", "reports", "streams")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can say the same, the SQL for DuckDB."""

    def add(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return add


def _load() -> None:
    for name in _PLANS:
        import_module(f"tidemark.plans.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_oracles)
