"""Registry of the engine's queries and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with equivalent DuckDB SQL if there is any."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return add


def _load() -> None:
    from torrentine.plans import linear_queries, map_queries, network_queries, overlay_queries, record_queries, scalar_queries  # noqa: F401


def entry(spark: SparkSession) -> DataFrame:
    _load()
    return _queries["adaptive_nearest"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
