"""Tables kept by key: the latest row of each key, in hash buckets of which a load rewrites only those it touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.schema import is_whole
from stratalake.operators.bronze import align
from stratalake.sources.lake import BUCKET, Lake, Load, again_if_late

#: Buckets of a table whose first load names no other number. One should hold no more than a few tasks read: 1 GB or so.
BUCKETS = 64


def latest_rows(df: DataFrame, key: str, order_by: str | None, newer: str | None = None) -> DataFrame:
    """One row per key: the one with the greatest ``order_by`` (null is least), of equal ones that with the greatest value of the column ``newer`` (which goes), else
    that with the greatest values in column order.

    Rows are combined per key in their own task first, so a key that comes often reaches the shuffle as one row per task.
    """
    columns = [c for c in df.columns if c != newer]
    first = [F.col(f"`{c}`").alias(alias) for c, alias in ((order_by, "_order"), (newer, "_rank")) if c]
    row = F.struct(*first, *[F.col(f"`{c}`") for c in columns if c != key])
    best = df.groupBy(F.col(f"`{key}`").alias(key)).agg(F.max(row).alias("_row"))
    return best.select(*[F.col(f"`{key}`") if c == key else F.col("_row")[c].alias(c) for c in columns])


def upsert(
    lake: Lake,
    layer: str,
    table: str,
    df: DataFrame,
    key: str,
    order_by: str | None = None,
    n_buckets: int = BUCKETS,
    replace_all: bool = False,
    **details,
) -> Load:
    """Put the rows of ``df`` into a table that has one row per key.

    A row replaces the stored one of its key unless that has a greater ``order_by``: changes may come late and in any order. Rows without a key are left
    out. Keys are hashed to ``n_buckets`` buckets when the table is made; a load reads and writes the buckets that its keys fall into, all others keep their files. New
    columns are added and types grow as in Bronze. ``replace_all`` makes the table anew. ``df`` is read twice, once for the buckets.
    """
    return again_if_late(lambda: _upsert_once(lake, layer, table, df, key, order_by, n_buckets, replace_all, details))


def _upsert_once(
    lake: Lake, layer: str, table: str, df: DataFrame, key: str, order_by: str | None, n_buckets: int, replace_all: bool, details: dict
) -> Load:
    previous = lake.latest(layer, table)
    if previous is not None and not previous.n_buckets and not replace_all:
        raise ValueError(f"{table} is not kept by key; rebuild it with replace_all")
    anew = previous is None or replace_all
    n = n_buckets if anew else previous.n_buckets
    batch = df.where(F.col(f"`{key}`").isNotNull())
    if not anew:
        before = previous.schema[key].dataType
        batch, schema = align(batch, previous.schema)
        if schema[key].dataType != before and not (is_whole(before) and is_whole(schema[key].dataType)):
            raise ValueError(f"the key {key} of {table} is {before.simpleString()}")
    # Of the text, so that a whole number has one bucket in any width.
    bucket = F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(n)).cast("int")
    counts = batch.groupBy(bucket.alias(BUCKET)).count().collect()  # a row for each bucket at most
    touched = {r[BUCKET] for r in counts}
    both = batch.withColumn("_newer", F.lit(1))
    if not anew:
        stored = lake.read(layer, table, load=previous, buckets=touched)
        both = both.unionByName(align(stored, schema)[0].withColumn("_newer", F.lit(0)))
    rows = latest_rows(both, key, order_by, "_newer").withColumn(BUCKET, bucket)
    return lake.write_upsert(layer, table, rows, touched, n, sum(r["count"] for r in counts), previous, replace_all, **details)
