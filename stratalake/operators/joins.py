"""Joins of a fact with its dimensions.

Sides are *prepared* first (key renamed to the fact's name, colliding columns dropped), so
every join is a USING join and no column is ever ambiguous. Which physical join runs is left
to Catalyst: a dimension is broadcast only while its size is under the session's limit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key is crowded when it holds this share of a dimension's rows and so many rows; it is cut in parts of about
# so many bytes, if that is less, and never of fewer rows.
SHARE = 0.0001
MIN_ROWS = 100_000
PART_BYTES = 256 << 20
# Sketches that the tasks' sketches are merged into before the last merge, and the most counters Spark's sketch takes.
SKETCHES = 64
MOST_COUNTERS = 1_000_000
DEAL = "_deal"

_COUNTABLE = (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)


def prepare_dimension(fact_columns: list[str], dim: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """The dimension with its key under the fact's name and without columns the fact has."""
    have = {c.lower() for c in fact_columns}
    clash = [c for c in dim.columns if c.lower() in have and c.lower() != right_key.lower()]
    dim = dim.drop(*clash)
    return dim if left_key == right_key else dim.withColumnRenamed(right_key, left_key)


def left_join(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return fact.join(dim, key, "left")


def full_join(fact: DataFrame, dim: DataFrame, key: str, left=left_join) -> DataFrame:
    """Full outer join with one coalesced key, as a left join plus the dimension rows no fact has.

    Spark can neither broadcast a side of a full outer join nor split its crowded keys. The
    left join allows both. The second part needs only the distinct keys of the fact, combined
    before they are shuffled; next to a dimension small enough to broadcast, those the
    dimension lacks are left out first, so no more keys move than the dimension has.
    """
    keys = fact.select(key)
    if is_broadcastable(dim):
        keys = keys.join(dim.select(key), key, "left_semi")
    unmatched = dim.join(keys.distinct(), key, "left_anti")
    return left(fact, dim, key).unionByName(unmatched, allowMissingColumns=True)


def heavy_keys(df: DataFrame, key: str, share: float) -> tuple[list[Row], int]:
    """(item, count) of the keys that hold ``share`` of the non-null rows, and the number of these rows. Runs one job over the key column.

    Every task counts with a bounded number of counters (a frequent-items sketch); its sketches are merged in a tree. What is moved follows the number of
    tasks and 1/share, not the number of keys. A key over the share is never missed, since the sketch errs by less than half of it; every key given does
    occur, and its count is at most that much too high. There are at most 2/share of them.
    """
    counters = min(MOST_COUNTERS, max(16, math.ceil(6 / share)))
    name = f"`{key}`"
    tasks = df.where(F.col(name).isNotNull()).groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCHES)).alias("_sketch"))
    merged = tasks.agg(F.expr(f"approx_top_k_accumulate({name}, {counters})").alias("_state"), F.count(F.lit(1)).alias("_rows"))
    whole = merged.groupBy(F.lit(0).alias("_all")).agg(F.expr(f"approx_top_k_combine(_state, {counters})").alias("_state"), F.sum("_rows").alias("_rows"))
    found = whole.select(F.expr(f"approx_top_k_estimate(_state, {min(counters, math.ceil(2 / share))})").alias("items"), "_rows").first()
    if found is None:  # no key at all
        return [], 0
    return [i for i in found["items"] if i["count"] >= found["_rows"] * share], found["_rows"]


def crowded_keys(dim: DataFrame, key: str, share: float | None = None, min_rows: int | None = None) -> list[tuple]:
    """(key, parts) of the dimension's keys that crowd a join, and into how many parts each is to be cut; see ``heavy_keys``."""
    share, min_rows = share or SHARE, min_rows or MIN_ROWS
    if not isinstance(dim.schema[key].dataType, _COUNTABLE):
        return []
    items, rows = heavy_keys(dim, key, share)
    enough = max(rows * share, min_rows)
    items = [i for i in items if i["count"] >= enough]
    if not items:
        return []
    in_part = min(enough, max(min_rows, PART_BYTES * rows / max(1, estimated_bytes(dim))))
    return [(i["item"], math.ceil(i["count"] / in_part)) for i in items]


def dealt(df: DataFrame) -> DataFrame:
    """With the row's place in its scan, unless it is there already."""
    return df if DEAL in df.columns else df.withColumn(DEAL, F.monotonically_increasing_id())


def spread_left_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    share: float | None = None,
    min_rows: int | None = None,
) -> DataFrame:
    """Left join that cuts the right side's crowded keys into parts, the more the larger the key.

    Spark splits a crowded left side of a left join by itself, but not the right one. The right side deals its rows of a crowded key out over the parts, the
    left side repeats its rows in each. Other keys are joined as usual. The join runs on (key, part), so a later group-by on the key shuffles again,
    after a partial aggregate, instead of inheriting the crowded partition. The crowded keys are found first, by one job over the right side's key
    column; without any this is a plain left join.

    There are at most 2/share crowded keys; that bound is why the driver may hold their list and broadcast it.

    A row's part comes from its place in the scan (``dealt``), so that exact copies part too. A
    retried task must deal the same way: when a side is itself the result of a shuffle, add that
    column before the shuffle.
    """
    found = crowded_keys(right, key, share, min_rows)
    if not found:
        return left_join(left, right.drop(DEAL), key)
    spark = left.sparkSession
    hot = spark.createDataFrame(found, T.StructType([T.StructField(key, right.schema[key].dataType), T.StructField("_parts", T.IntegerType())]))
    place, parts = F.col(DEAL), F.col("_parts")
    # Null keys match nothing; they are dealt out so that they do not crowd one task.
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    usual = F.when(F.col(f"`{key}`").isNull(), F.pmod(place, F.lit(tasks))).otherwise(F.lit(0)).cast("int")

    def parted(df: DataFrame, crowded) -> DataFrame:
        df = dealt(df).join(F.broadcast(hot), key, "left")
        return df.withColumn("_part", F.explode(F.when(parts.isNull(), F.array(usual)).otherwise(crowded)))

    lefts = parted(left, F.sequence(F.lit(0), parts - 1)).withColumn("_repeated", parts.isNotNull()).drop("_parts")
    rights = parted(right, F.array(F.pmod(place, parts).cast("int"))).drop(DEAL, "_parts")
    joined = lefts.join(rights.withColumn("_matched", F.lit(True)), [key, "_part"], "left")
    # A repeated left row has a match in some part (its key does occur on the right), so its copies in parts without one are no result rows.
    joined = joined.where(~(F.col("_repeated") & F.col("_matched").isNull())).drop("_part", "_repeated", "_matched")
    return joined if DEAL in left.columns else joined.drop(DEAL)


def estimated_bytes(df: DataFrame) -> int:
    """Spark's size estimate of a DataFrame."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def is_broadcastable(df: DataFrame) -> bool:
    """Is the size estimate under the session's broadcast limit?"""
    spark = df.sparkSession
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    if raw.strip().startswith("-"):  # broadcasting is off
        return False
    limit = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(raw)
    return estimated_bytes(df) <= limit
