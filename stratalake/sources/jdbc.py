"""JDBC source: full and incremental reads, split over many tasks."""

from __future__ import annotations

import getpass
import os
from collections.abc import Sequence
from dataclasses import dataclass, field
from decimal import Decimal, InvalidOperation

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.schema import is_numeric

POSTGRES_DRIVER = "org.postgresql.Driver"


@dataclass(frozen=True)
class JdbcTable:
    """A table behind a JDBC URL. The driver jar comes with the session."""

    url: str
    table: str
    properties: dict = field(default_factory=dict, repr=False)

    @classmethod
    def postgresql(
        cls,
        table: str,
        host: str = "localhost",
        port: int = 5432,
        database: str = "postgres",
        user: str | None = None,
        password: str | None = None,
    ) -> JdbcTable:
        """User and password default to ``PG_USERNAME`` (or the login name) and ``PG_PASSWORD``."""
        return cls(
            f"jdbc:postgresql://{host}:{port}/{database}",
            table,
            {
                "user": user or os.environ.get("PG_USERNAME") or getpass.getuser(),
                "password": password if password is not None else os.environ.get("PG_PASSWORD", ""),
                "driver": POSTGRES_DRIVER,
            },
        )

    def named(self, table: str) -> JdbcTable:
        return JdbcTable(self.url, table, self.properties)


def _scan(spark: SparkSession, source: JdbcTable, table: str, **options) -> DataFrame:
    asked = {**source.properties, **{k: str(v) for k, v in options.items()}}
    return spark.read.format("jdbc").options(url=source.url, dbtable=table, **asked).load()


def column_bounds(spark: SparkSession, source: JdbcTable, column: str) -> tuple[str | None, str | None]:
    """Smallest and largest value of ``column`` as text, computed by the database in one row."""
    query = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {source.table}) bounds"
    row = _scan(spark, source, query)
    if is_numeric(row.schema["lo"].dataType):
        row = row.select(F.floor("lo").alias("lo"), F.ceil("hi").alias("hi"))
    found = row.select(F.col("lo").cast("string"), F.col("hi").cast("string")).first()
    return (found["lo"], found["hi"]) if found else (None, None)


def read_jdbc(
    spark: SparkSession,
    source: JdbcTable,
    partition_column: str | None = None,
    num_partitions: int = 64,
    bounds: tuple | None = None,
    lower: str | None = None,
    predicates: Sequence[str] | None = None,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Scan a table.

    With ``partition_column`` (number, date or timestamp) the scan is split into
    ``num_partitions`` ranges between ``bounds`` (asked of the database when not given; ``lower``
    replaces the lower one, for a scan that will be filtered from there on). Rows outside the
    bounds still belong to the first or last range. Ranges are of equal width, so for a column
    with crowded values give ``predicates`` instead: one WHERE clause per task, disjoint and
    together covering every row. With neither, one task reads the whole table.

    Filters and column choices made on the result are pushed into the database.
    """
    if predicates:
        properties = {**source.properties, "fetchsize": str(fetch_size)}
        return spark.read.jdbc(
            source.url, source.table, predicates=list(predicates), properties=properties
        )
    lo = hi = None
    if partition_column is not None:
        lo, hi = bounds if bounds is not None else column_bounds(spark, source, partition_column)
    if lower is not None and hi is not None and _above(lower, hi):
        lo = None  # nothing is new: Spark refuses such bounds, and a filter from there on finds nothing
    if lo is None or hi is None:  # no split asked for, an empty table, or only NULLs
        return _scan(spark, source, source.table, fetchsize=fetch_size)
    return _scan(
        spark,
        source,
        source.table,
        fetchsize=fetch_size,
        partitionColumn=partition_column,
        lowerBound=lo if lower is None else lower,
        upperBound=hi,
        numPartitions=num_partitions,
    )


def _above(a, b) -> bool:
    """Is a bound greater than another? Numbers by value, dates and times by their text."""
    try:
        return Decimal(str(a)) > Decimal(str(b))
    except InvalidOperation:
        return str(a) > str(b)


def tables_exist(spark: SparkSession, source: JdbcTable, wanted: Sequence[str]) -> DataFrame:
    """(source, exists) per wanted ``schema.table`` (schema defaults to ``public``)."""
    names = [n.strip().split(".", 1) if "." in n else ["public", n.strip()] for n in wanted]
    asked = spark.createDataFrame(
        [(w, s.strip(), t.strip()) for w, (s, t) in zip(wanted, names, strict=True)],
        "source string, table_schema string, table_name string",
    )
    known = read_jdbc(spark, source.named("information_schema.tables"))
    return match_tables(asked, known)


def match_tables(asked: DataFrame, known: DataFrame) -> DataFrame:
    """Which of the asked (table_schema, table_name) pairs a listing knows."""
    keys = ["table_schema", "table_name"]
    found = known.select(*keys).distinct().withColumn("found", F.lit(True))
    return asked.join(found, keys, "left").select(
        "source", F.coalesce("found", F.lit(False)).alias("exists")
    )
