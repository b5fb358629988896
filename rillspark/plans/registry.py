"""Names every query of the library's own operators and the SQL it is compared with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "i03_topn_per_window"
MODULES = ("sources_sinks", "rows", "aggregates", "windows", "watermarks", "joins", "state", "topn_functions", "patterns", "streams")
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under ``name``."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for module in MODULES:
        importlib.import_module(f"rillspark.plans.{module}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
