"""Runs a Gold plan: dict -> DataFrame."""

from __future__ import annotations

import logging
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.measures import flag
from stratalake.functions.names import BAD_RECORD
from stratalake.functions.schema import is_numeric
from stratalake.operators import joins as J
from stratalake.operators.aggregates import (
    ROWS,
    Aggregate,
    can_multiply,
    is_name,
    parts_of,
    quoted,
    text_column,
    whole,
)
from stratalake.plans.spec import GoldPlan, PlanError
from stratalake.sources.lake import Lake

log = logging.getLogger(__name__)

STRATEGIES = ("auto", "plain", "two_step", "eager", "spread")


@dataclass(frozen=True)
class Side:
    """A table of the plan, ready to join: key under the fact's name, no colliding columns."""

    name: str
    df: DataFrame
    key: str | None = None
    type: str | None = None


def build_gold(
    tables: dict[str, DataFrame],
    plan: dict | GoldPlan,
    strict: bool = True,
    as_of: str | None = None,
    strategy: str = "auto",
) -> DataFrame:
    """The Gold table a plan describes. Everything is checked here, before any job starts (looking for crowded keys, which some
    strategies need, starts one after that).

    ``strict=False`` leaves out aggregates and group-by columns that do not exist instead of
    raising. ``as_of`` (``YYYY-MM-DD``) stands in for ``current_date()`` in the plan's expressions.

    ``strategy`` says how rows meet; the result is the same:

    * ``plain``: join, then aggregate. Best while the dimensions can be broadcast.
    * ``two_step``: aggregate the table the measures come from per join key, join those few
      rows, merge. A crowded key shrinks to one row per task before anything is shuffled.
      Needs every aggregate to read one table only.
      Distinct values are carried as sets; which join keys crowd their table is asked by a job that runs here.
    * ``eager``: aggregate every table per join key and count its rows; a joined row then stands for the product of
      these counts. For plans whose aggregates read several tables: each is scanned once, only partial results are
      moved, and keys that come often on both sides make no product of rows. What an expression over two tables reads
      stays in the grouping.
    * ``spread``: join with crowded keys of a dimension cut in parts (see ``spread_left_join``); looking for them is a job that
      runs here.
    * ``auto``: ``plain`` if all dimensions are under the broadcast limit, else ``two_step`` if
      the plan allows it, else ``eager`` for the tables over the limit, else (texts spliced into an aggregate, sums that
      a product would round) ``spread`` for the dimensions over the limit.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    plan, sides = prepared(tables, plan, strict, as_of)
    grouped = grouped_rows(plan, sides, J.left_join)
    if not plan.joins or strategy == "plain":
        return finished(plan, grouped)

    large = [s for s in sides[1:] if not J.is_broadcastable(s.df)]
    if strategy == "auto" and not large:
        return finished(plan, grouped)
    measured = _measured_side(plan, sides)
    if strategy == "auto":
        strategy = "two_step" if measured is not None else "eager" if _multiplies(plan, sides) else "spread"
        combined = {i for i, s in enumerate(sides) if s in large or i == 0 and not J.is_broadcastable(s.df)}
    else:
        large, combined = sides[1:], set(range(len(sides)))
    if strategy == "eager":
        if not _multiplies(plan, sides):
            raise PlanError("eager needs aggregates that can be multiplied by a number of rows")
        grouped = _eager(plan, sides, combined, grouped.schema)
    elif strategy == "two_step":
        if measured is None:
            raise PlanError("two_step needs all aggregates to read one table")
        grouped = _eager(plan, sides, {measured}, grouped.schema)
    else:
        spread = _spreading({s.key for s in large})
        grouped = grouped_rows(plan, [replace(sides[0], df=J.dealt(sides[0].df)), *sides[1:]], spread)
    return finished(plan, grouped)


def write_gold(lake: Lake, df: DataFrame, destination: str) -> int:
    """Replace a Gold table; returns its row count."""
    return lake.overwrite("gold", destination, df)


def run_gold(lake: Lake, plan: dict | GoldPlan, **options) -> int:
    """Read the plan's Silver tables, build and store its Gold table; returns the row count."""
    plan = GoldPlan.from_dict(plan)
    names = {plan.fact, *(j.dim for j in plan.joins)}
    tables = {n: lake.read("silver", n) for n in names}
    return write_gold(lake, build_gold(tables, plan, **options), plan.destination)


# -- preparing ------------------------------------------------------------------


def prepared(tables: dict[str, DataFrame], plan: dict | GoldPlan, strict: bool, as_of: str | None) -> tuple[GoldPlan, list[Side]]:
    """The checked plan and its tables, ready to join."""
    plan = GoldPlan.from_dict(plan)
    plan.check(tables)
    sides = _sides(tables, plan)
    plan = _plain_texts(plan, sides, as_of)
    plan = _known_columns(plan, sides, strict)
    return plan, [replace(s, df=_needed_columns(plan, sides, s)) for s in sides]


def _sides(tables: dict[str, DataFrame], plan: GoldPlan) -> list[Side]:
    fact = tables[plan.fact].drop(BAD_RECORD)
    sides = [Side(plan.fact, fact)]
    types = {f.name: f.dataType for f in fact.schema.fields}
    for join in plan.joins:
        dim = tables[join.dim].drop(BAD_RECORD)
        left, right = join.keys
        if left not in types:
            raise PlanError(f"join key {left!r} is not among {sorted(types)}")
        if right not in dim.columns:
            raise PlanError(f"join key {right!r} is not in {join.dim!r}: {dim.columns}")
        _check_key_types(join.dim, left, types[left], dim.schema[right].dataType)
        dim = J.prepare_dimension(list(types), dim, left, right)
        types.update({f.name: f.dataType for f in dim.schema.fields if f.name != left})
        sides.append(Side(join.dim, dim, left, join.type))
    return sides


def _check_key_types(table: str, key: str, a: T.DataType, b: T.DataType) -> None:
    if a != b and not (is_numeric(a) and is_numeric(b)):
        raise PlanError(
            f"join key {key!r} is {a.simpleString()} on the left and {b.simpleString()} in {table!r}"
        )


def _mentioned(names, *texts: str) -> set[str]:
    """Which of the names expressions mention (lower case): a superset of the columns they read."""
    low = " ".join(texts).lower()
    words = set(re.findall(r"\w+", low))
    return {n for n in map(str.lower, names) if (n in words if re.fullmatch(r"\w+", n) else n in low)}


def _texts(plan: GoldPlan) -> list[str]:
    return (
        plan.group_by
        + plan.filters
        + [p["expression"] for p in plan.pre_columns]
        + [c for a in plan.aggregations for c in a.inputs]
    )


def _needed_columns(plan: GoldPlan, sides: list[Side], side: Side) -> DataFrame:
    """The columns of a side the plan reads; its size estimate is then that of what moves."""
    keys = [s.key for s in sides if s.key]
    needed = _mentioned(side.df.columns, *_texts(plan), *keys)
    return side.df.select(*[quoted(c) for c in side.df.columns if c.lower() in needed])


def _plain_texts(plan: GoldPlan, sides: list[Side], as_of: str | None) -> GoldPlan:
    """Drop table qualifiers (prepared sides share no names) and fix the current date."""
    columns = {s.name.lower(): {c.lower() for c in s.df.columns} for s in sides}

    def bare(match: re.Match) -> str:
        table, column = match[1].lower(), match[2]
        if table not in columns:
            return match[0]
        if column.lower() not in columns[table]:
            raise PlanError(f"{match[0]} is not available: the fact side has a column of that name, "
                            f"or {match[1]!r} has none")
        return column

    def clean(text: str) -> str:
        pieces = re.split(r"('(?:[^'\\]|\\.)*')", text)  # string literals stay untouched
        for i in range(0, len(pieces), 2):
            pieces[i] = re.sub(r"\b(\w+)\.(\w+)\b", bare, pieces[i])
            if as_of is not None:
                pieces[i] = re.sub(
                    r"\bcurrent_date\b(\s*\(\s*\))?", f"DATE'{as_of}'", pieces[i], flags=re.IGNORECASE
                )
        return "".join(pieces)

    return replace(
        plan,
        group_by=[clean(c) for c in plan.group_by],
        filters=[clean(f) for f in plan.filters],
        pre_columns=[{**p, "expression": clean(p["expression"])} for p in plan.pre_columns],
        aggregations=[
            replace(a, col=clean(a.col), den=clean(a.den) if a.den else a.den)
            for a in plan.aggregations
        ],
        derived_columns=[{**d, "expression": clean(d["expression"])} for d in plan.derived_columns],
    )


def _known_columns(plan: GoldPlan, sides: list[Side], strict: bool) -> GoldPlan:
    known = _plan_columns(plan, sides)

    def missing(agg: Aggregate) -> list[str]:
        return [c for c in agg.inputs if is_name(c) and c.lower() not in known]

    lost_groups = [c for c in plan.group_by if c.lower() not in known]
    lost_aggs = [a for a in plan.aggregations if missing(a)]
    if strict and (lost_groups or lost_aggs):
        raise PlanError(
            f"unknown columns: {lost_groups + [c for a in lost_aggs for c in missing(a)]}; "
            f"there are {sorted(known)}"
        )
    for agg in lost_aggs:
        log.warning("left out %s(%s): no such column", agg.func, agg.col)
    group_by = [c for c in plan.group_by if c not in lost_groups]
    if plan.group_by and not group_by:
        raise PlanError(f"none of the group-by columns exists: {plan.group_by}")
    aggregations = [
        replace(
            a,
            **{
                part: quoted(text)
                for part, text in (("col", a.col), ("den", a.den))
                if text and text.lower() in known
            },
        )
        for a in plan.aggregations
        if a not in lost_aggs
    ]
    return replace(
        plan,
        group_by=group_by,
        aggregations=aggregations or [Aggregate("COUNT", "*", "record_count")],
    )


def _analysed(what: str, step):
    try:
        return step()
    except AnalysisException as e:
        raise PlanError(f"{what}: {e}") from e


# -- one step -------------------------------------------------------------------


def _fold(sides: list[Side], left_join) -> DataFrame:
    df = sides[0].df
    for side in sides[1:]:
        if side.type == "full":
            df = J.full_join(df, side.df, side.key, left_join)
        else:
            df = left_join(df, side.df, side.key)
    return df


def _spreading(keys: set[str]):
    """A left join that spreads crowded keys of the right side for the given join keys."""

    def join(left: DataFrame, dim: DataFrame, key: str) -> DataFrame:
        return (J.spread_left_join if key in keys else J.left_join)(left, dim, key)

    return join


def _filtered(df: DataFrame, filters: list[str]) -> DataFrame:
    for text in filters:
        df = _analysed(f"filter {text!r}", lambda df=df, text=text: df.where(F.expr(text)))
    return df


def _joined(plan: GoldPlan, sides: list[Side], left_join) -> DataFrame:
    """All sides with the pre-columns."""
    df = _fold(sides, left_join)
    for p in plan.pre_columns:
        df = _analysed(
            f"pre column {p['column']!r}",
            lambda df=df, p=p: df.withColumn(p["column"], F.expr(p["expression"])),
        )
    return df


def filtered_rows(plan: GoldPlan, sides: list[Side], left_join) -> DataFrame:
    """The joined rows that are aggregated."""
    return _filtered(_joined(plan, sides, left_join), plan.filters)


def grouped_rows(plan: GoldPlan, sides: list[Side], left_join) -> DataFrame:
    df = filtered_rows(plan, sides, left_join)
    return _analysed(
        "aggregates",
        lambda: df.groupBy(*map(quoted, plan.group_by)).agg(*[whole(a) for a in plan.aggregations]),
    )


def finished(plan: GoldPlan, df: DataFrame) -> DataFrame:
    renames = {
        a["from"]: a["to"]
        for a in plan.column_aliases
        if a.get("from") in df.columns and a.get("to") and a["from"] != a["to"]
    }
    df = df.withColumnsRenamed(renames)
    for d in plan.derived_columns:
        value = F.expr(d["expression"])
        if str(d.get("type", "")).lower() in ("boolean", "bool"):
            value = flag(value)
        df = _analysed(
            f"derived column {d['column']!r}",
            lambda df=df, d=d, value=value: df.withColumn(d["column"], value),
        )
    return df


# -- which table an expression reads ------------------------------------------------------------------


def _reads_only(df: DataFrame, text: str, known: set[str]) -> bool:
    """Does an expression read no column but those of ``df``? The plan was analysed before, and
    prepared sides share no names, so words that are columns of the plan decide it."""
    return _mentioned(known, text) <= {c.lower() for c in df.columns}


def _plan_columns(plan: GoldPlan, sides: list[Side]) -> set[str]:
    return {c.lower() for s in sides for c in s.df.columns} | {
        p["column"].lower() for p in plan.pre_columns
    }


def _own_pre_columns(plan: GoldPlan, df: DataFrame, known: set[str]) -> tuple[DataFrame, set[str]]:
    """The pre-columns that read only this table, computed on it."""
    own = set()
    for p in plan.pre_columns:
        if _reads_only(df, p["expression"], known):
            df = df.withColumn(p["column"], F.expr(p["expression"]))
            own.add(p["column"])
    return df, own


def _measured_side(plan: GoldPlan, sides: list[Side]) -> int | None:
    """The largest table that all aggregates can be computed on."""
    if any(a.is_opaque for a in plan.aggregations):
        return None
    known = _plan_columns(plan, sides)
    inputs = [c for a in plan.aggregations for c in a.inputs]
    fits = []
    for i, side in enumerate(sides):
        df, _ = _own_pre_columns(plan, side.df, known)
        if all(_reads_only(df, c, known) for c in inputs):
            fits.append(i)
    return max(fits, key=lambda i: J.estimated_bytes(sides[i].df), default=None)


# -- eager aggregation -----------------------------------------------------------


def _multiplies(plan: GoldPlan, sides: list[Side]) -> bool:
    return can_multiply(_joined(plan, sides, J.left_join), plan.aggregations)


def _eager(plan: GoldPlan, sides: list[Side], combined: set[int], schema: T.StructType) -> DataFrame:
    """Join the ``combined`` tables as partial aggregates per join key, with the number of rows of each.

    Distinct values travel as sets, one for each partial row. After the join they are taken apart again, the other parts staying with the first value, and
    Spark counts them by group and value, so that a group of half the rows is spread over tasks by its values.
    """
    known = _plan_columns(plan, sides)
    whole_row = _joined(plan, sides, J.left_join)  # analysed only
    dfs, own = [], {}  # own: pre-columns that one combined table gives, and its number
    for i, side in enumerate(sides):
        df, names = side.df, set()
        if i in combined:
            rest = replace(plan, pre_columns=[p for p in plan.pre_columns if p["column"] not in own])
            df, names = _own_pre_columns(rest, df, known)
        own |= dict.fromkeys(names, i)
        dfs.append(df)

    def home(text: str) -> int | None:
        """The table whose partial aggregate holds what the text reads. None: it is taken over joined rows."""
        fits = (i for i in sorted(combined) if text and _mentioned(known, text) and _reads_only(dfs[i], text, known))
        return next(fits, None)

    parts = {a.alias: parts_of(whole_row, a) for a in plan.aggregations if a.func != "COUNT_DISTINCT"}
    placed = {(alias, j): (part, home(part.reads)) for alias, (ps, _) in parts.items() for j, part in enumerate(ps)}
    number = {a.alias: n for n, a in enumerate(plan.aggregations)}
    names = {(alias, j): f"_p{number[alias]}_{j}" for alias, j in placed}
    distinct = {a.alias: a.col for a in plan.aggregations if a.func == "COUNT_DISTINCT"}
    sets = {alias: (f"_set{number[alias]}", at) for alias, text in distinct.items() if (at := home(text)) is not None}

    early = []
    if 0 in combined and all(s.type == "left" for s in sides[1:]):
        early = [f for f in plan.filters if _reads_only(dfs[0], f, known)]
        dfs[0] = _filtered(dfs[0], early)
    late = [f for f in plan.filters if f not in early]

    texts = plan.group_by + late + [text for alias, text in distinct.items() if alias not in sets]
    texts += [part.reads for part, at in placed.values() if at is None] + [s.key for s in sides[1:]]
    for p in reversed(plan.pre_columns):
        if p["column"] not in own and _mentioned([p["column"]], *texts):
            texts.append(p["expression"])

    rows, kept, joining = {i: f"{ROWS}{i}" for i in sorted(combined)}, {}, []
    for i, side in enumerate(sides):
        used = _mentioned(dfs[i].columns, *texts)
        kept[i] = [c for c in dfs[i].columns if c.lower() in used]
        df = dfs[i].select(*map(quoted, kept[i]))
        if i in combined:
            here = [part.whole().alias(names[place]) for place, (part, at) in placed.items() if at == i]
            values = {name: text_column(distinct[alias]) for alias, (name, at) in sets.items() if at == i}
            here += [F.collect_set(v).alias(name) for name, v in values.items()]
            keys = [side.key] if i else [s.key for s in sides[1:] if s.key in dfs[i].columns][:1]
            df = _slotted(dfs[i], keys, list(values.values())) if values else dfs[i]
            df = df.groupBy(*map(quoted, kept[i]), *([_SLOT] if values else [])).agg(F.count(F.lit(1)).alias(rows[i]), *here).drop(_SLOT)
        joining.append(replace(side, df=df))
    joined = _fold(joining, J.left_join)

    # Rows an outer join filled with NULLs take the value the expressions have on NULL inputs.
    gone = {f.name: f.dataType for df in dfs for f in df.schema.fields if f.name not in joined.columns}
    joined = joined.withColumns({c: F.lit(None).cast(t) for c, t in gone.items()})
    for p in plan.pre_columns:
        name, value = p["column"], F.expr(p["expression"])
        if name in own and name in kept[own[name]]:
            value = F.when(F.col(rows[own[name]]).isNull(), value).otherwise(F.col(quoted(name)))
        joined = joined.withColumn(name, value)
    joined = _filtered(joined, late)

    first = F.lit(True)
    if sets:
        filled = {name: F.when(F.col(rows[at]).isNull(), F.array(text_column(distinct[alias]))).otherwise(F.col(name)) for alias, (name, at) in sets.items()}
        values = F.posexplode_outer(F.arrays_zip(*filled)).alias("_place", "_value")
        joined = joined.withColumns(filled).select("*", values).drop(*filled)
        first = F.coalesce(F.col("_place"), F.lit(0)) == 0

    def weight(at: int | None) -> Column | None:
        counts = [F.coalesce(F.col(c), F.lit(1)) for i, c in rows.items() if i != at]
        return reduce(Column.__mul__, counts) if counts else None

    def over_joined(place: tuple[str, int]) -> Column:
        part, at = placed[place]
        value = F.when(part.value.isNotNull(), 1).otherwise(0) if part.kind == "count" else part.value
        if at is not None:
            value = F.when(F.col(rows[at]).isNull(), value).otherwise(F.col(names[place]))
        return part.multiplied(F.when(first, value) if sets else value, weight(at))

    def distinct_values(a: Aggregate) -> Column:
        if a.alias not in sets:
            return whole(a)
        count = F.count_distinct(F.col("_value")[sets[a.alias][0]])
        return (F.round(count, a.round) if a.round is not None else count).alias(a.alias)

    results = [
        distinct_values(a) if a.func == "COUNT_DISTINCT" else parts[a.alias][1]([over_joined((a.alias, j)) for j in range(len(parts[a.alias][0]))])
        for a in plan.aggregations
    ]
    grouped = joined.groupBy(*map(quoted, plan.group_by)).agg(*results)
    return grouped.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])


_SLOT = "_slot"


def _slotted(df: DataFrame, keys: list[str], values: list[Column]) -> DataFrame:
    """With a slot that cuts the sets of crowded join keys, by their values, so that none has more than a part's rows (see ``crowded_keys``)."""
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    slot = F.lit(0)
    for key in keys:
        found = J.crowded_keys(df, key)
        place = F.xxhash64(*values)
        if found:
            types = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("_parts", T.IntegerType())])
            df = df.join(F.broadcast(df.sparkSession.createDataFrame(found, types)), key, "left")
            slot = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(place, F.col("_parts")))
        slot = F.when(F.col(quoted(key)).isNull(), F.pmod(place, F.lit(tasks))).otherwise(slot)
    return df.withColumn(_SLOT, slot.cast("int"))
