"""From wanted output column names to a Gold plan, by the schemas of the inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.schema import is_id_name, is_numeric, is_temporal
from stratalake.operators.aggregates import Aggregate
from stratalake.plans.gold import build_gold
from stratalake.plans.spec import GoldPlan, JoinSpec, PlanError

# How a name spells its aggregate.
_PREFIXES = {
    "total_": "SUM",
    "sum_": "SUM",
    "avg_": "AVG",
    "average_": "AVG",
    "mean_": "AVG",
    "max_": "MAX",
    "maximum_": "MAX",
    "last_": "MAX",
    "latest_": "MAX",
    "min_": "MIN",
    "minimum_": "MIN",
    "first_": "MIN",
    "earliest_": "MIN",
    "count_": "COUNT",
    "num_": "COUNT",
    "cnt_": "COUNT",
}
_SUFFIXES = {"_total": "SUM", "_average": "AVG"}
_ANY_TYPE = ("last_", "latest_", "first_", "earliest_")
_ROW_COUNTS = ("count", "record_count", "row_count", "records", "total_count")
_ROW_COUNT_ENDINGS = ("_count", "_transactions")
_FLAGS = ("is_", "has_", "flag_")
_KEY_PRIORITY = ("customer_id", "user_id", "order_id", "product_id", "employee_id")


@dataclass(frozen=True)
class Resolved:
    """How one wanted column is made."""

    name: str
    kind: str  # group, aggregate or flag
    column: str | None = None
    func: str | None = None
    condition: str | None = None


def _columns(inputs: dict[str, DataFrame]) -> dict[str, T.DataType]:
    columns: dict[str, T.DataType] = {}
    for df in inputs.values():
        for f in df.schema.fields:
            if not f.name.startswith("_"):
                columns.setdefault(f.name, f.dataType)
    return columns


def _operand(text: str, columns: dict[str, T.DataType], fits) -> str | None:
    """The column a name means: exact, else the only one that contains it."""
    able = [c for c, t in columns.items() if fits(t)]
    exact = [c for c in able if c.lower() == text]
    if exact:
        return exact[0]
    within = [c for c in able if text and text in c.lower()]
    return within[0] if len(within) == 1 else None


def resolve_column(
    name: str, columns: dict[str, T.DataType], conditions: dict[str, str] | None = None
) -> Resolved:
    """One wanted name, by the first rule that holds: an existing column, a row count, an
    aggregate prefix or suffix, a flag with a condition. Raises with candidates otherwise."""
    low = name.lower()
    exact = [c for c in columns if c.lower() == low]
    if exact:
        return Resolved(name, "group", exact[0])

    prefix = next((p for p in _PREFIXES if low.startswith(p)), None)
    rest = low[len(prefix) :] if prefix else low
    if low in _ROW_COUNTS or rest in _ROW_COUNTS or rest.endswith(_ROW_COUNT_ENDINGS):
        return Resolved(name, "aggregate", "*", "COUNT")

    if prefix:
        func = _PREFIXES[prefix]
        if func == "COUNT":
            column = _operand(rest, columns, lambda t: True)
            if column is None and not any(rest in c.lower() for c in columns):
                column = "*"
        elif prefix in _ANY_TYPE:
            column = _operand(rest, columns, lambda t: True)
        elif func in ("MIN", "MAX"):
            column = _operand(rest, columns, lambda t: is_numeric(t) or is_temporal(t))
        else:
            column = _operand(rest, columns, is_numeric)
        if column is not None:
            return Resolved(name, "aggregate", column, func)
    suffix = next((s for s in _SUFFIXES if low.endswith(s)), None)
    if suffix:
        column = _operand(low[: -len(suffix)], columns, is_numeric)
        if column is not None:
            return Resolved(name, "aggregate", column, _SUFFIXES[suffix])

    condition = (conditions or {}).get(name)
    if condition is not None:
        return Resolved(name, "flag", condition=condition)
    if low.startswith(_FLAGS):
        raise PlanError(f"{name!r} is a flag; give its condition, such as total_x > 300")
    near = [c for c in columns if rest in c.lower() or c.lower() in low][:4]
    raise PlanError(f"cannot make {name!r}; candidates: {near or sorted(columns)}")


def shared_keys(inputs: dict[str, DataFrame]) -> list[str]:
    """Column names that occur in two tables or more: the usual business keys first, then other
    ids, then the rest."""
    seen: dict[str, int] = {}
    for df in inputs.values():
        for c in df.columns:
            if not c.startswith("_"):
                seen[c] = seen.get(c, 0) + 1

    def order(name: str):
        first = _KEY_PRIORITY.index(name) if name in _KEY_PRIORITY else len(_KEY_PRIORITY)
        return first, not is_id_name(name), name

    return sorted((c for c, n in seen.items() if n >= 2), key=order)


def shared_columns(columns: DataFrame) -> DataFrame:
    """The same over a catalog of columns (``catalog.columns_of``): (column_name, tables, is_id)."""
    is_id = (F.col("column_name") == "id") | F.col("column_name").endswith("_id")
    return (
        columns.where(~F.col("is_audit"))
        .groupBy("column_name")
        .agg(F.count_distinct("table_name").alias("tables"))
        .where(F.col("tables") >= 2)
        .withColumn("is_id", is_id)
    )


def plan_from_columns(
    inputs: dict[str, DataFrame],
    wanted: list[str],
    on: str | dict[str, str] | None = None,
    conditions: dict[str, str] | None = None,
    destination: str | None = None,
) -> GoldPlan:
    """A plan that yields the wanted columns: existing ones become the grouping, in the order
    asked for, the others aggregates or flags. The first input is the fact; the others are left
    joined ``on`` a key (one for all, or per table), by default the best shared one."""
    columns = _columns(inputs)
    made = [resolve_column(n, columns, conditions) for n in wanted]
    fact, *dims = list(inputs)
    joins = []
    for dim in dims:
        key = on.get(dim) if isinstance(on, dict) else on
        if key is None:
            keys = shared_keys({fact: inputs[fact], dim: inputs[dim]})
            if not keys:
                raise PlanError(f"{fact!r} and {dim!r} share no column; say what to join on")
            key = keys[0]
        joins.append(JoinSpec(dim, key, "left", fact))
    aggregates = [Aggregate(r.func, r.column, r.name) for r in made if r.kind == "aggregate"]
    return GoldPlan(
        source_tables=list(inputs),
        group_by=[r.column for r in made if r.kind == "group"],
        aggregations=aggregates or [Aggregate("COUNT", "*", "record_count")],
        joins=joins,
        column_aliases=[
            {"from": r.column, "to": r.name} for r in made if r.kind == "group" and r.column != r.name
        ],
        derived_columns=[
            {"column": r.name, "expression": r.condition, "type": "boolean"}
            for r in made
            if r.kind == "flag"
        ],
        destination=destination or "_".join(inputs) + "_gold",
    )


def gold_from_columns(
    inputs: dict[str, DataFrame],
    wanted: list[str],
    on: str | dict[str, str] | None = None,
    conditions: dict[str, str] | None = None,
    **options,
) -> DataFrame:
    """Resolve the wanted columns and run the plan; columns come in the order asked for."""
    plan = plan_from_columns(inputs, wanted, on, conditions)
    out = build_gold(inputs, plan, **options)
    extra = [c for c in out.columns if c not in wanted]
    return out.select(*wanted, *extra)
