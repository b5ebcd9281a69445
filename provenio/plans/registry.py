"""Queries over the driver's tables: name -> function of (spark, sf_dir), and the SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: adds a query, with its SQL if there is one."""

    def add(function):
        _QUERIES[name] = function
        if sql is not None:
            _SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan: a fact row for each lockfile, and for each repository or release without one."""
    return queries()["scan_facts"](spark, sf_dir)


def _load() -> None:
    from provenio.plans import evidence_queries, page_queries, relation_queries, resolve_queries, scalar_queries, scan_queries  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
