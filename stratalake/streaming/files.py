"""File ingest that takes each source file exactly once, however often it runs."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.names import check_table_name
from stratalake.operators.bronze import align, fit, with_audit
from stratalake.sources.files import FORMATS, read_source
from stratalake.sources.lake import STREAM, Lake, Load, again_if_late
from stratalake.sources.storage import first_lines, is_dir


def new_files(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the names of the files in a folder, or of one file; it opens none of them."""
    reader = spark.readStream.format("binaryFile").schema(
        "path string, modificationTime timestamp, length long, content binary"
    )
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if not is_dir(spark, path):
        path = f"{path[:-1]}[{path[-1]}]"  # the stream takes one file only as a pattern
    return reader.load(path).select("path")


def _literal(path: str) -> str:
    """A path whose pattern characters stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def by_header(spark: SparkSession, paths: Sequence[str], comment: str | None) -> list[list[str]]:
    """CSV files grouped by their header line, the first that is neither blank nor a comment.

    Of each file only the first block is read, whatever its size.
    """

    def header(path: str) -> str:
        return next((line for line in first_lines(spark, path) if line.strip(" ") and not (comment and line.startswith(comment))), "")

    with ThreadPoolExecutor(32) as pool:
        headers = list(pool.map(header, paths))
    groups: dict[str, list[str]] = {}
    for path, text in sorted(zip(paths, headers, strict=True)):
        if text:
            groups.setdefault(text, []).append(path)
    return [groups[text] for text in sorted(groups)]


def _read_files(
    spark: SparkSession, paths: Sequence[str], fmt: str, known: T.StructType, base: str | None, options: dict
) -> Iterator[DataFrame]:
    """The files as one table per header (CSV) or one in all; known columns get their known types. With audit columns."""
    options = {**options, "merge_schema": True, "base": base}
    for group in by_header(spark, paths, options.get("comment")) if fmt in ("csv", "tsv") else [list(paths)]:
        files = [_literal(p) for p in group]
        types = {f.name.lower(): f.dataType for f in known.fields}
        found = read_source(spark, files, fmt, infer=False, **options).schema
        if any(f.name.lower() not in types for f in found.fields) and fmt in ("csv", "tsv"):
            found = read_source(spark, files, fmt, **options).schema
        if fmt != "parquet":  # a Parquet file's own types are widened by ``align``
            found = T.StructType([T.StructField(f.name, types.get(f.name.lower(), f.dataType)) for f in found.fields])
        df = read_source(spark, files, fmt, found, **options)
        yield with_audit(df, "", "incremental").withColumn("_source_name", F.col("_metadata.file_path"))


def ingest_new_files(
    lake: Lake,
    path: str,
    table: str,
    schema: T.StructType | str | None = None,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = 10_000,
    **options,
) -> int:
    """Append the files of a folder that were not ingested before, then stop; gives the new rows.

    A stream of file names, with its checkpoint beside the layers, decides which files make up a batch. Each
    batch is read by the files' own headers, fitted to the stored schema (missing columns become NULL, new ones are added,
    types widen or are refused) and committed as one load that keeps the batch's number: a batch that is
    repeated after a failure either was committed and is passed over, or overwrites what the failure left.
    ``schema`` gives types of columns; others are inferred, per batch, and fitted to the stored ones. Of CSV files the first block is read for
    the header. ``max_files_per_trigger`` bounds the files, and so the list of names, of a batch. ``options`` are those of
    ``read_source``: ``comment``, ``multi_line``, ``allow_comments``, ``sampling_ratio`` and ``merge_schema`` (which always holds here).
    """
    unknown = set(options) - {"comment", "multi_line", "allow_comments", "sampling_ratio", "merge_schema"}
    if unknown:
        raise ValueError(f"no such options of file increments: {sorted(unknown)}")
    options = {"comment": "/", **options}
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {sorted(FORMATS)}, not {fmt!r}")
    spark = lake.spark
    before = lake.latest("bronze", table)
    if before is not None and before.source_type != STREAM:
        raise ValueError(f"{table} is loaded in batches; stream into another table")
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema or T.StructType([])
    base = path if is_dir(spark, path) else None
    added: list[int] = []

    def store(batch: DataFrame, number: int) -> None:
        # Names, of at most max_files_per_trigger files; where one holds pattern characters the stream may name others twice.
        files = sorted({row.path for row in batch.collect()})
        if files and (load := again_if_late(lambda: store_files(files, number))):
            added.append(load.rows)

    def store_files(files: list[str], number: int) -> Load | None:
        previous = lake.latest("bronze", table)
        if previous is not None and previous.batch is not None and previous.batch >= number:
            return None
        stored = previous.schema if previous else None
        # Stored strings take any text; other stored types must not turn what they cannot hold into NULL.
        strings = [f for f in stored.fields if isinstance(f.dataType, T.StringType)] if stored else []
        known = {f.name.lower(): f for f in [*strings, *given.fields]}
        parts, merged = [], stored
        for part in _read_files(spark, files, fmt, T.StructType(list(known.values())), base, options):
            if merged is not None:
                part, merged = fit(part, merged)
            parts.append(part)
            merged = merged or part.schema
        if not parts:
            return None
        parts = [align(part, merged)[0] for part in parts]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return lake.write_load(
            "bronze", table, whole, "incremental", schema=merged, source_type=STREAM, source_name=path, previous=previous, batch=number
        )

    query = (
        new_files(spark, path, max_files_per_trigger)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{lake.root}/_checkpoints/{check_table_name(table)}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(added)
