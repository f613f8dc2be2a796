"""Names, queries and SQL of the operators' registered queries."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    """Add a query, with the SQL that gives the same rows where there is one."""
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


def oracle_of(name: str) -> str:
    """The SQL of a query registered before: its stream form has the same."""
    return _ORACLES[name]


def _load() -> None:
    """Import the modules that register queries."""
    from . import MODULES

    for name in MODULES:
        import_module(f"{__package__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return _QUERIES


def oracles() -> dict[str, str]:
    _load()
    return _ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["flagship"](spark, sf_dir)
