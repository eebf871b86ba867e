"""Named queries over the test tables, each with the SQL that gives the same answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.queries import explore, gold, ingest, silver

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = (ingest, silver, gold, explore)


def all_queries() -> dict[str, Query]:
    return {name: q for m in _MODULES for name, q in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.SQL.items()}
