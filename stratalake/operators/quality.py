"""Checks on keys and bad records. Each is one pass with the rows combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.names import BAD_RECORD


def key_audit(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, null_keys, distinct_keys, duplicate_keys (keys with more than one row) and
    surplus_rows (rows beyond the first of their key)."""
    per_key = df.groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known, n = F.col("k").isNotNull(), F.col("n")
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(~known, n)), F.lit(0)).alias("null_keys"),
        F.count_if(known).alias("distinct_keys"),
        F.count_if(known & (n > 1)).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(known, n - 1)), F.lit(0)).alias("surplus_rows"),
    )


def key_coverage(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None) -> DataFrame:
    """One row: how many fact rows have a key, find it in the dimension, or are orphans.

    The fact is counted per key first, so the join sees each key once however many rows it has.
    """
    per_key = (
        fact.where(F.col(fact_key).isNotNull())
        .groupBy(F.col(fact_key).alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    known = dim.select(F.col(dim_key or fact_key).alias("k")).distinct().withColumn("found", F.lit(True))
    joined = per_key.join(known, "k", "left")
    found = F.coalesce("found", F.lit(False))
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_with_key"),
        F.coalesce(F.sum(F.when(found, F.col("n"))), F.lit(0)).alias("matched_rows"),
        F.coalesce(F.sum(F.when(~found, F.col("n"))), F.lit(0)).alias("orphan_rows"),
        F.count_if(~found).alias("orphan_keys"),
    )


def orphans(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None) -> DataFrame:
    """The fact rows whose key the dimension lacks (rows without a key are none)."""
    known = dim.select(F.col(dim_key or fact_key).alias(fact_key)).distinct()
    return fact.where(F.col(fact_key).isNotNull()).join(known, fact_key, "left_anti")


def split_bad_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows without the bad-record column, bad rows with it).

    Take the input from a stored table rather than from the raw JSON source, which Spark will not
    query for that column alone.
    """
    if BAD_RECORD not in df.columns:
        return df, df.withColumn(BAD_RECORD, F.lit(None).cast("string")).where(F.lit(False))
    bad = F.col(BAD_RECORD).isNotNull()
    return df.where(~bad).drop(BAD_RECORD), df.where(bad)
