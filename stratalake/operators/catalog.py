"""What the layers hold: tables, columns, files, load state; views and SQL over all of it."""

from __future__ import annotations

import base64
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalake.functions.names import view_name
from stratalake.functions.schema import column_role, is_audit
from stratalake.sources.lake import LAYERS, Lake
from stratalake.sources.statistics import bound


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rows, columns) in one job; Parquet answers each count from its footers."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table_name"), "rows", F.lit(len(df.columns)).alias("columns")
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def layer_catalog(lake: Lake, layers=LAYERS) -> DataFrame:
    """(layer, table_name, rows, columns) of every table.

    The manifest of a table knows both, so one small file is opened for each; only tables without one are counted by their footers.
    """
    known, parts = [], []
    for layer in layers:
        loads = lake.latest_loads(layer)
        names = lake.tables(layer)
        known += [(layer, t, loads[t].table_rows, len(loads[t].schema)) for t in names if t in loads]
        others = {t: lake.read(layer, t) for t in names if t not in loads}
        if others:
            parts.append(row_counts(others).select(F.lit(layer).alias("layer"), "*"))
    logged = lake.spark.createDataFrame(known, "layer string, table_name string, rows long, columns int")
    return reduce(DataFrame.unionByName, parts, logged)


def table_statistics(lake: Lake, layers=LAYERS) -> DataFrame:
    """(layer, table_name, column_name, data_type, rows, non_null, min, max, distinct_estimate) from the manifests, opening no table.

    Least and greatest value as text, of strings by their first characters; the number of distinct values errs by about 3 percent.
    """
    rows = []
    for layer in layers:
        for table, load in lake.latest_loads(layer).items():
            found = load.statistics()
            for f in load.schema.fields:
                if f.name in found:
                    c = found[f.name]
                    sketches = [base64.b64decode(x) for x in (c["sketch"] or "").split()]
                    low, high = bound(c["min"], f.dataType), bound(c["max"], f.dataType)
                    rows.append((layer, table, f.name, f.dataType.simpleString(), load.table_rows, c["n"], low, high, sketches))
    keys = "layer string, table_name string, column_name string, data_type string, rows long, non_null long, min string, max string"
    each = lake.spark.createDataFrame(rows, f"{keys}, sketches array<binary>").withColumn("sketch", F.explode_outer("sketches")).drop("sketches")
    distinct = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0)).alias("distinct_estimate")
    return each.groupBy(*each.columns[:-1]).agg(distinct)


def load_overview(lake: Lake) -> DataFrame:
    """Bronze tables with their latest load; tables nobody logged show NULLs."""
    state = lake.load_state("bronze").drop("rows", "schema", "partition_by", "source_load_id", "batch")
    return layer_catalog(lake, ("bronze",)).join(state, "table_name", "left")


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type, role, is_audit) from schemas alone."""
    rows = [
        (t, f.name, f.dataType.simpleString(), column_role(f.name, f.dataType), is_audit(f.name))
        for t, df in tables.items()
        for f in df.schema.fields
    ]
    return spark.createDataFrame(
        rows,
        "table_name string, column_name string, data_type string, role string, is_audit boolean",
    )


def file_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, size, modified) per Parquet file below ``path``.

    The binary source lists files and, with its content column left out, opens none of them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(path)
    )
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def register_views(lake: Lake, layers=LAYERS, text: str | None = None) -> list[str]:
    """A temporary view per table of the layers; ``-`` in a name becomes ``_``.

    With ``text`` only those tables whose view name occurs in it, in any case; each costs one small file of the load log. Tables that would
    take the same name are refused.
    """
    found: dict[str, list] = {}
    for layer in layers:
        if text is None:
            tables = lake.read_all(layer)
        else:
            tables = {t: lake.read(layer, t) for t in lake.tables(layer) if view_name(t).lower() in text.lower()}
        for table, df in tables.items():
            found.setdefault(view_name(table).lower(), []).append((layer, table, df))
    for view, made in found.items():
        if len(made) > 1:
            raise ValueError(f"several tables make the view {view!r}: {[f'{layer}/{table}' for layer, table, _ in made]}")
    for ((_, table, df),) in found.values():
        df.createOrReplaceTempView(view_name(table))
    return [view_name(table) for ((_, table, _),) in found.values()]


def run_sql(lake: Lake, text: str) -> DataFrame:
    """Spark SQL over all layers; the caller decides what to do with the rows.

    Only the tables that the statement names become views; ``register_views`` makes all, as ``SHOW VIEWS`` would need.
    """
    register_views(lake, text=text)
    return lake.spark.sql(text)


def default_query(table: str, limit: int = 20) -> str:
    return f"SELECT * FROM {view_name(table)} LIMIT {int(limit)}"


def preview(df: DataFrame, rows: int = 50) -> DataFrame:
    """The first rows; reads no more files than it needs for them."""
    return df.limit(rows)
