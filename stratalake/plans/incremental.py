"""Gold tables that follow their Silver table load by load.

Beside a Gold table stands its state: per group the parts of all aggregates (sums, counts, minima, maxima) and the distinct values that are counted, as loads that cover
the loads of the fact table. A run aggregates the new loads only, adds them to the state and merges the state, which has a row per group and load, into the
Gold table.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalake.operators import joins as J
from stratalake.operators.aggregates import Aggregate, parts_of, quoted, text_column, whole
from stratalake.plans.gold import Side, filtered_rows, finished, grouped_rows, prepared, run_gold
from stratalake.plans.spec import GoldPlan
from stratalake.sources.lake import Lake, again_if_late

#: A state of so many loads is merged into one.
MOST_LOADS = 16

_CLOCK = re.compile(r"current_(date|timestamp)|\bnow\s*\(|localtimestamp|curdate|\brand", re.IGNORECASE)


def state_name(destination: str) -> str:
    return f"{destination}_state"


def refresh_gold(lake: Lake, plan: dict | GoldPlan, strict: bool = True, as_of: str | None = None) -> int:
    """Bring a Gold table up to date with the loads that its fact table has got since the last run; returns its row count.

    Only those loads of the fact table are read. Everything is read anew, and what a replaced load had added goes, when the fact table was replaced or is kept by
    key, when a dimension or the plan has changed, or when the plan asks for the current time without ``as_of``. Plans with a full join, whose unmatched
    rows depend on all loads, and aggregates spliced from text are always built in full.
    """
    plan = GoldPlan.from_dict(plan)
    if any(j.type == "full" for j in plan.joins) or any(a.is_opaque for a in plan.aggregations):
        return run_gold(lake, plan, strict=strict, as_of=as_of)
    load = again_if_late(lambda: _add_to_state(lake, plan, strict, as_of))
    state = lake.read("gold", state_name(plan.destination), load=load)
    tables = {n: lake.read("silver", n) for n in {plan.fact, *(j.dim for j in plan.joins)}}
    ready, sides = prepared(tables, plan, strict, as_of)
    return lake.overwrite("gold", plan.destination, finished(ready, _merged(ready, sides, state)))


def _add_to_state(lake: Lake, plan: GoldPlan, strict: bool, as_of: str | None):
    name = state_name(plan.destination)
    fact, dims = lake.latest("silver", plan.fact), {j.dim: lake.latest("silver", j.dim) for j in plan.joins}
    told = json.dumps(asdict(plan), sort_keys=True, default=str)
    made_from = {"plan": hashlib.sha256(told.encode()).hexdigest(), "strict": strict, "as_of": as_of, "dims": {d: load.load_id if load else None for d, load in dims.items()}}
    source = json.dumps(made_from, sort_keys=True)
    state = lake.latest("gold", name)
    covered = state.source_load_id if state else None
    same = state is not None and state.source_name == source and not (as_of is None and _CLOCK.search(told))
    add = same and fact is not None and covered is not None and covered >= fact.first_load_id
    if add and covered == fact.load_id:
        return state
    tables = {n: lake.read("silver", n, load=load) for n, load in dims.items()}
    tables[plan.fact] = lake.read("silver", plan.fact, covered if add else None, load=fact)
    ready, sides = prepared(tables, plan, strict, as_of)
    new = _partial(ready, sides)
    if add and state.load_id - state.first_load_id + 2 > MOST_LOADS:
        new, add = _combined(ready, sides, lake.read("gold", name, load=state).unionByName(new)), False
    return lake.write_load(
        "gold", name, new, "incremental" if add else "full", source_type="state", source_name=source, source_load_id=fact.load_id if fact else None, previous=state
    )


def _parts(plan: GoldPlan, sides: list[Side]) -> dict[str, tuple]:
    """(part, what its results are merged by) of each state column."""
    row = filtered_rows(plan, sides, J.left_join)  # analysed only
    by = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}
    return {
        f"_p{i}_{j}": (part, by[part.kind])
        for i, a in enumerate(plan.aggregations)
        if a.func != "COUNT_DISTINCT"
        for j, part in enumerate(parts_of(row, a)[0])
    }


def _distinct(plan: GoldPlan) -> dict[str, Aggregate]:
    return {f"_d{i}": a for i, a in enumerate(plan.aggregations) if a.func == "COUNT_DISTINCT"}


def _partial(plan: GoldPlan, sides: list[Side]) -> DataFrame:
    """State rows of the given rows: a row per group and distinct values."""
    rows = filtered_rows(plan, sides, J.left_join)
    values = [text_column(a.col).alias(name) for name, a in _distinct(plan).items()]
    return rows.groupBy(*map(quoted, plan.group_by), *values).agg(*[part.whole().alias(name) for name, (part, _) in _parts(plan, sides).items()] or [F.count(F.lit(1)).alias("_rows")])


def _combined(plan: GoldPlan, sides: list[Side], state: DataFrame) -> DataFrame:
    """Several states as one."""
    keys = [*map(quoted, plan.group_by), *_distinct(plan)]
    merged = [by(name).cast(state.schema[name].dataType).alias(name) for name, (_, by) in _parts(plan, sides).items()]
    return state.groupBy(*keys).agg(*merged or [F.sum("_rows").alias("_rows")])


def _merged(plan: GoldPlan, sides: list[Side], state: DataFrame) -> DataFrame:
    """The Gold groups of a state, in the types that a full build has."""
    parts, row = _parts(plan, sides), filtered_rows(plan, sides, J.left_join)

    def result(i: int, a: Aggregate) -> Column:
        if a.func == "COUNT_DISTINCT":
            return whole(Aggregate(a.func, f"_d{i}", a.alias, round=a.round))
        found, combine = parts_of(row, a)
        columns = [parts[f"_p{i}_{j}"][1](f"_p{i}_{j}") for j in range(len(found))]
        return combine([F.coalesce(c, F.lit(0)) if p.kind == "count" else c for c, p in zip(columns, found, strict=True)])

    grouped = state.groupBy(*map(quoted, plan.group_by)).agg(*[result(i, a) for i, a in enumerate(plan.aggregations)])
    schema = grouped_rows(plan, sides, J.left_join).schema
    return grouped.select(*[F.col(quoted(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields])
