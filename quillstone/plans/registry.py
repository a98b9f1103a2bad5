"""Named queries of the engine's own operators, each with the SQL that must give the same rows."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillstone.storage import ship

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query under a name, with its SQL where SQL can express it."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries are called {name}")

        @functools.wraps(query)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        _QUERIES[name] = run
        if sql is not None:
            _ORACLE[name] = sql
        return query

    return add


#: Modules that register queries when they are imported.
AREAS = ("objects", "profiling", "linking", "checking", "insights", "statistics", "knowledge", "changing", "relations", "discovering", "running", "measuring")


def _load() -> None:
    for area in AREAS:
        importlib.import_module(f"quillstone.plans.{area}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders over a price with the customer they link to."""
    return queries()["qb_19_include"](spark, sf_dir)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)
