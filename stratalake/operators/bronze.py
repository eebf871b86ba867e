"""Bronze: raw rows plus audit columns, appended or replaced, with load state."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.names import AUDIT_COLUMNS
from stratalake.functions.schema import wider_type
from stratalake.sources.lake import STREAM, Lake, Load, again_if_late, watermark_text, watermark_value


class SchemaConflict(ValueError):
    """An incoming column whose type cannot be combined with the stored one."""


def with_audit(df: DataFrame, source_name: str, mode: str) -> DataFrame:
    return df.withColumns(
        {
            "_ingestion_timestamp": F.current_timestamp(),
            "_source_name": F.lit(source_name),
            "_load_mode": F.lit(mode),
        }
    )


def align(df: DataFrame, stored: T.StructType) -> tuple[DataFrame, T.StructType]:
    """Fit a batch to a stored schema and give the schema of both together.

    Stored columns the batch lacks become NULL, new ones are added at the end, and a
    difference in type is settled by widening without loss or refused before any write.
    Names are matched without case, as Spark resolves them.
    """
    incoming = {f.name.lower(): f for f in df.schema.fields}
    known = {f.name.lower() for f in stored.fields}
    columns, fields, conflicts = [], [], []
    for field in stored.fields:
        new = incoming.get(field.name.lower())
        if new is None:
            columns.append(F.lit(None).cast(field.dataType).alias(field.name))
            fields.append(field)
            continue
        both = wider_type(field.dataType, new.dataType)
        if both is None:
            conflicts.append(
                f"{field.name}: {field.dataType.simpleString()} -> {new.dataType.simpleString()}"
            )
            continue
        columns.append(F.col(f"`{new.name}`").cast(both).alias(field.name))
        fields.append(T.StructField(field.name, both))
    if conflicts:
        raise SchemaConflict("types changed: " + ", ".join(conflicts))
    for field in df.schema.fields:
        if field.name.lower() not in known:
            columns.append(F.col(f"`{field.name}`"))
            fields.append(field)
    return df.select(*columns), T.StructType(fields)


def fit(df: DataFrame, stored: T.StructType) -> tuple[DataFrame, T.StructType]:
    """``align``, but a column without any value in the batch, whose inferred type says nothing, takes the stored type."""
    try:
        return align(df, stored)
    except SchemaConflict:
        types = {f.name.lower(): f.dataType for f in stored.fields}
        differ = [f.name for f in df.schema.fields if wider_type(types.get(f.name.lower(), f.dataType), f.dataType) is None]
        values = df.agg(*[F.count(F.col(f"`{c}`")) for c in differ]).first()
        empty = [c for c, n in zip(differ, values, strict=True) if n == 0]
        if not empty:
            raise
    columns = [F.lit(None).cast(types[c.lower()]).alias(c) if c in empty else F.col(f"`{c}`") for c in df.columns]
    return align(df.select(*columns), stored)


def newer_than(df: DataFrame, column: str, load: Load | None, lookback: str | None = None) -> DataFrame:
    """Rows above the stored watermark, compared with a typed literal so the filter reaches
    the source. ``lookback`` (an SQL literal such as ``interval 1 hour`` or ``100``) lowers
    the limit to catch rows that arrived late with an old value."""
    if load is None or load.last_watermark_value is None:
        return df
    limit = watermark_value(load.last_watermark_value, df.schema[column].dataType)
    if lookback is not None:
        limit = limit - F.expr(lookback)
    return df.where(F.col(column) > limit)


def _with_watermark(lake: Lake, table: str, load: Load, column: str) -> Load:
    """The load with its watermark for ``column``. When earlier loads kept none (or one of another
    column) it is taken from the stored rows, so that they are not loaded again."""
    if load.watermark_col == column and load.last_watermark_value is not None:
        return load
    if column not in load.schema.names:  # no stored row has a value, and another column's says nothing
        return replace(load, watermark_col=column, last_watermark_value=None)
    stored = lake.read("bronze", table, load=load)
    high = stored.agg(watermark_text(stored, column)).first()[0]
    return replace(load, watermark_col=column, last_watermark_value=high)


def load_bronze(
    lake: Lake,
    table: str,
    df: DataFrame,
    source_name: str,
    mode: str = "full",
    source_type: str = "file",
    watermark_col: str | None = None,
    lookback: str | None = None,
    key: Sequence[str] | str | None = None,
    partition_by: Sequence[str] = (),
) -> Load:
    """Store one batch of a source in Bronze and commit its load state.

    ``full`` replaces the table. ``incremental`` keeps the stored rows, reads only rows above
    the stored watermark when ``watermark_col`` is given, and lets the schema grow.
    With ``lookback`` the rows read twice are told apart by ``key``. A load that comes late, after another writer's, is put on top of
    it, or made anew if it reads from a watermark on.
    """
    if mode not in ("full", "incremental"):
        raise ValueError(f"mode must be 'full' or 'incremental', not {mode!r}")
    if lookback is not None and not key:
        raise ValueError("lookback needs a key to tell re-read rows apart")
    return again_if_late(
        lambda: _load_once(lake, table, df, source_name, mode, source_type, watermark_col, lookback, key, partition_by)
    )


def _load_once(
    lake: Lake,
    table: str,
    df: DataFrame,
    source_name: str,
    mode: str,
    source_type: str,
    watermark_col: str | None,
    lookback: str | None,
    key: Sequence[str] | str | None,
    partition_by: Sequence[str],
) -> Load:
    previous = lake.latest("bronze", table)
    schema = None
    if mode == "incremental" and previous is not None:
        if previous.source_type == STREAM:
            raise ValueError(f"{table} is filled by a file stream; load batches into another table")
        if watermark_col:
            previous = _with_watermark(lake, table, previous, watermark_col)
            df = newer_than(df, watermark_col, previous, lookback)
        batch = with_audit(df, source_name, mode)
        batch, schema = fit(batch, previous.schema)
        if lookback is not None and previous.last_watermark_value is not None:
            keys = [key] if isinstance(key, str) else list(key)
            stored = newer_than(lake.read("bronze", table, load=previous), watermark_col, previous, lookback)
            batch = batch.join(stored.select(*keys), keys, "left_anti")
    else:
        batch = with_audit(df, source_name, mode)
    return lake.write_load(
        "bronze",
        table,
        batch,
        mode,
        schema=schema,
        source_type=source_type,
        source_name=source_name,
        watermark_col=watermark_col,
        partition_by=partition_by,
        previous=previous,
    )


def data_columns(df: DataFrame) -> DataFrame:
    """Without the audit columns."""
    return df.drop(*AUDIT_COLUMNS)
