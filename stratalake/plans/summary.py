"""Default summary of a Silver table, planned from its schema."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.names import summary_name
from stratalake.functions.schema import infer_key, is_id_name, is_numeric, is_temporal
from stratalake.operators.aggregates import Aggregate
from stratalake.plans.gold import build_gold, write_gold
from stratalake.plans.spec import GoldPlan, PlanError
from stratalake.sources.lake import Lake

# String columns with these endings identify rows rather than group them.
_NOT_DIMENSION = ("_id", "_email", "_name")
_MEASURE = re.compile(
    r"(count\s+distinct|sum|avg|count|max|min)\s*\(\s*(\w+|\*)\s*\)\s*(?:as\s+(\w+))?$", re.IGNORECASE
)


def _sum_and_avg(column: str) -> list[Aggregate]:
    return [Aggregate("SUM", column, f"total_{column}"), Aggregate("AVG", column, f"avg_{column}")]


def _measure(text: str, columns: list[str]) -> list[Aggregate]:
    """``SUM(price) as revenue``, ``MAX(day)``, or a bare column for its sum and average."""
    match = _MEASURE.match(text.strip())
    if match:
        func, column = re.sub(r"\s+", "_", match[1].upper()), match[2]
        named = [Aggregate(func, column, match[3] or f"{match[1].lower()}_{column}".replace(" ", "_"))]
    else:
        column, named = text.strip(), _sum_and_avg(text.strip())
    if column != "*" and column not in columns:
        raise PlanError(f"measure {text!r}: no column {column!r}; there are {columns}")
    return named


def summary_plan(
    schema: T.StructType,
    table: str,
    key: str | None = None,
    group_by: list[str] | None = None,
    measures: list[str] | None = None,
    destination: str | None = None,
) -> GoldPlan:
    """Group by the first two dimensions and the first date; count, and sum and average measures.

    Dimensions are strings that do not name or identify a row, measures are numbers that are no
    id; columns starting with ``_`` and the key are neither. ``group_by`` and ``measures`` replace
    the defaults. With no dimension or date, the first id column is the group.
    """
    fields = [f for f in schema.fields if not f.name.startswith("_")]
    names = [f.name for f in fields]
    key = key or infer_key(T.StructType(fields))
    rest = [f for f in fields if f.name != key]
    dims = [
        f.name
        for f in rest
        if isinstance(f.dataType, T.StringType) and not f.name.endswith(_NOT_DIMENSION)
    ]
    dates = [f.name for f in rest if is_temporal(f.dataType)]
    numbers = [f.name for f in rest if is_numeric(f.dataType) and not is_id_name(f.name)]
    ids = [n for n in names if is_id_name(n)]

    wanted = [c for c in group_by or [] if c in names]
    if group_by and len(wanted) < len(group_by):
        raise PlanError(f"no such columns: {sorted(set(group_by) - set(names))}; there are {names}")
    groups = wanted or dims[:2] + dates[:1] or ids[:1]
    if not groups:
        raise PlanError(f"{table}: no column to group by")
    aggregates = [Aggregate("COUNT", "*", "record_count")]
    for text in measures or []:
        aggregates += _measure(text, names)
    if not measures:
        aggregates += [a for c in numbers if c not in groups for a in _sum_and_avg(c)]
    return GoldPlan([table], groups, aggregates, destination=destination or summary_name(table))


def auto_summary(
    df: DataFrame,
    table: str = "table",
    key: str | None = None,
    group_by: list[str] | None = None,
    measures: list[str] | None = None,
    ordered: bool = True,
) -> DataFrame:
    """The default summary, largest groups first (``ordered=False`` spares the global sort)."""
    out = build_gold({table: df}, summary_plan(df.schema, table, key, group_by, measures))
    return out.orderBy(F.desc("record_count")) if ordered else out


def run_summary(lake: Lake, silver_table: str) -> int:
    """Store the default summary of a Silver table in Gold; returns the row count."""
    summary = auto_summary(lake.read("silver", silver_table), silver_table)
    return write_gold(lake, summary, summary_name(silver_table))
