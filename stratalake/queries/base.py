"""What the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalake.sources.lake import Lake
from stratalake.sources.storage import scratch_dir

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def new_lake(spark: SparkSession, name: str) -> Lake:
    return Lake(spark, scratch_dir(spark, name))


class Registry:
    """Collects the queries and SQL texts of a module."""

    def __init__(self):
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None):
        """Register a function under its own or the given name, with the SQL of the same answer."""

        def add(fn):
            self.queries[name or fn.__name__] = fn
            if sql is not None:
                self.sql[name or fn.__name__] = sql
            return fn

        return add
