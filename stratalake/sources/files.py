"""File sources: CSV, TSV, JSON lines and Parquet behind one reader."""

from __future__ import annotations

import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratalake.sources.storage import path_exists

log = logging.getLogger(__name__)

FORMATS = ("csv", "tsv", "json", "parquet")

# Suffixes of compression codecs that Spark undoes itself.
_COMPRESSED = ("gz", "bz2", "deflate", "lz4", "snappy", "zst")


class MissingSource(FileNotFoundError):
    """A source path that does not exist."""


def format_of(path: str) -> str:
    """Format by suffix, that of a compression left aside; ``csv`` when there is none."""
    last = path.rstrip("/").split("/")[-1]
    stem, _, suffix = last.rpartition(".")
    if suffix.lower() in _COMPRESSED and stem:
        last = stem
    return last.rsplit(".", 1)[-1].lower() if "." in last.lstrip(".") else "csv"


def read_source(
    spark: SparkSession,
    path: str | Sequence[str],
    fmt: str | None = None,
    schema: T.StructType | str | None = None,
    comment: str | None = "/",
    multi_line: bool = False,
    allow_comments: bool = False,
    sampling_ratio: float | None = None,
    merge_schema: bool = False,
    base: str | None = None,
    infer: bool = True,
) -> DataFrame:
    """Read a file or directory in the given format (default: the suffix decides).

    CSV and TSV have a header; lines that start with ``comment`` are skipped (pass None to
    keep them). JSON is one object per line; lines that do not parse land in
    ``_corrupt_record``. ``multi_line`` and ``allow_comments`` read pretty-printed or
    commented JSON whole instead. ``merge_schema`` puts the columns of differing Parquet files
    together. CSV files whose header differs from the first one's (or from ``schema``) are
    refused rather than read by position. ``path`` may be a list of files of one format, ``base`` then names the folder
    whose subfolders hold partition values. Without ``infer`` CSV columns stay strings. A format this reader does not know is read as
    plain CSV with a header.

    Without ``schema`` CSV and JSON cost one more pass over the input to infer it; on large
    inputs pass a schema, or a ``sampling_ratio``.
    """
    paths = [path] if isinstance(path, str) else list(path)
    fmt = (fmt or format_of(paths[0])).lower()
    if isinstance(path, str) and not path_exists(spark, path):
        raise MissingSource(f"no such source: {path}")
    reader = spark.read.option("basePath", base) if base else spark.read
    if schema is not None:
        reader = reader.schema(schema)
    elif sampling_ratio is not None:
        reader = reader.option("samplingRatio", sampling_ratio)

    if fmt == "parquet":
        return reader.option("mergeSchema", merge_schema).parquet(*paths)
    if fmt == "json":
        return reader.json(paths, multiLine=multi_line, allowComments=allow_comments)
    if fmt not in FORMATS:
        log.warning("format %r is not known, reading %s as CSV", fmt, path)
        comment = None
    if comment is not None:
        reader = reader.option("comment", comment)
    sep = "\t" if fmt == "tsv" else ","
    return reader.csv(paths, header=True, inferSchema=infer and schema is None, sep=sep, enforceSchema=False)


def files_exist(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(source, exists) per path, asked of the file system without reading data."""
    rows = [(p, path_exists(spark, p)) for p in paths]
    return spark.createDataFrame(rows, "source string, exists boolean")
