"""Queries by name with the SQL that must give the same rows."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}

#: Modules that register queries.
MODULES: list[str] = ["scalars", "relational", "corpus", "catalog", "turkish", "structure", "flows", "letters", "spools"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function of (spark, sf_dir) under a name."""

    def add(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"query {name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    for name in MODULES:
        importlib.import_module(f"corpusloom.plans.{name}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: lexical search over chunks by coverage and idf share."""
    return queries()["rt_lexical_coverage"](spark, sf_dir)


def queries() -> dict[str, Query]:
    load()
    return _queries


def oracle_sql() -> dict[str, str]:
    load()
    return _sql
