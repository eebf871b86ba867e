"""Silver: snake_case names, canonical types, key not null. One projection and one filter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalake.functions.names import silver_name, to_snake_case
from stratalake.functions.schema import canonical_columns, infer_key
from stratalake.operators.bronze import align
from stratalake.operators.upsert import upsert
from stratalake.sources.lake import Lake, Load, again_if_late


def snake_case_columns(df: DataFrame) -> DataFrame:
    """Rename only; types stay."""
    return df.toDF(*[to_snake_case(c) for c in df.columns])


def to_silver(
    df: DataFrame,
    pk: str | None = None,
    widen: bool = False,
    keep_boolean: bool = False,
    nested: str = "string",
    dedupe: bool = False,
) -> DataFrame:
    """Rename, cast and drop rows without a key.

    ``pk`` overrides the key the column names suggest. ``dedupe`` keeps one row per key
    (off by default: the key is not promised to be unique).
    """
    key = pk or infer_key(df.schema)
    columns = canonical_columns(df.schema, widen, keep_boolean, nested)
    raw_key = next((c for c in df.columns if to_snake_case(c) == key), None)
    if raw_key is None:
        raise ValueError(f"key {key!r} is not a column: {[to_snake_case(c) for c in df.columns]}")
    # Tested before the cast, where the scan can take the filter over.
    silver = df.where(F.col(f"`{raw_key}`").isNotNull()).select(*columns)
    return silver.dropDuplicates([key]) if dedupe else silver


def build_silver(
    lake: Lake,
    bronze_table: str,
    pk: str | None = None,
    widen: bool = False,
    keep_boolean: bool = False,
    nested: str = "string",
    incremental: bool = False,
    partition_by: Sequence[str] = (),
    latest_by: str | None = None,
) -> Load:
    """Bronze table -> Silver table of the same base name.

    The default rewrites the whole table. ``incremental`` reads only the Bronze loads that
    came after the last Silver run (partition pruning on the load id) and adds them; a
    replaced Bronze table is taken over in full again. A run that comes late, after another one's, looks again what is new.
    With ``latest_by`` the table keeps one row per key, the one with the greatest value there (see ``upsert``).
    """
    return again_if_late(lambda: _build_once(lake, bronze_table, pk, widen, keep_boolean, nested, incremental, partition_by, latest_by))


def _build_once(
    lake: Lake, bronze_table: str, pk: str | None, widen: bool, keep_boolean: bool, nested: str, incremental: bool, partition_by: Sequence[str],
    latest_by: str | None,
) -> Load:
    table = silver_name(bronze_table)
    source = lake.latest("bronze", bronze_table)
    done = lake.latest("silver", table)
    covered = done.source_load_id if done else None
    add = incremental and source is not None and covered is not None and covered >= source.first_load_id
    if add and covered == source.load_id:
        return done
    bronze = lake.read("bronze", bronze_table, covered if add else None, load=source)
    silver = to_silver(bronze, pk, widen, keep_boolean, nested)
    if latest_by is not None:
        key, covers = pk or infer_key(bronze.schema), source.load_id if source else None
        return upsert(lake, "silver", table, silver, key, latest_by, replace_all=not add, source_type="layer", source_name=bronze_table, source_load_id=covers)
    schema = None
    if add:
        silver, schema = align(silver, done.schema)
    return lake.write_load(
        "silver",
        table,
        silver,
        "incremental" if add else "full",
        schema=schema,
        source_type="layer",
        source_name=bronze_table,
        partition_by=partition_by,
        source_load_id=source.load_id if source else None,
        previous=done,
    )
