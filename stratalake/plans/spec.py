"""The Gold plan: what to join, keep, group and compute."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from stratalake.operators.aggregates import FUNCTIONS, Aggregate

JOIN_TYPES = ("left", "full")


class PlanError(ValueError):
    """A plan that cannot run; raised before any job starts."""


@dataclass(frozen=True)
class JoinSpec:
    dim: str
    on: str
    type: str = "left"
    fact: str | None = None

    @classmethod
    def from_dict(cls, d: dict) -> JoinSpec:
        kind = str(d.get("type") or "left").strip().lower()
        kind = re.sub(r"[\s_]*(outer)?[\s_]*(join)?$", "", kind)
        return cls(d["dim"], str(d["on"]).strip(), kind, d.get("fact"))

    @property
    def keys(self) -> tuple[str, str]:
        """(left, right) key names. ``a.x = b.y`` names both, a single name serves both sides."""
        left, _, right = self.on.partition("=")
        left = left.split(".")[-1].strip()
        right = right.lstrip("=").split(".")[-1].strip() or left
        return left, right


@dataclass(frozen=True)
class GoldPlan:
    """One Gold table.

    Order of steps: joins, ``pre_columns``, ``filters``, group-by with aggregates,
    ``column_aliases``, ``derived_columns``. Filters come after the joins, so a condition on a
    dimension column also drops the rows the dimension did not match.
    """

    source_tables: list[str]
    group_by: list[str]
    aggregations: list[Aggregate]
    joins: list[JoinSpec] = field(default_factory=list)
    filters: list[str] = field(default_factory=list)
    pre_columns: list[dict] = field(default_factory=list)
    column_aliases: list[dict] = field(default_factory=list)
    derived_columns: list[dict] = field(default_factory=list)
    destination: str = "gold"

    @classmethod
    def from_dict(cls, plan: dict | GoldPlan) -> GoldPlan:
        if isinstance(plan, GoldPlan):
            return plan
        if "cross_table_hint" in plan:
            return plan_from_hint(plan)
        if "source_silver" in plan:  # the plan of a single table, or of "a + b"
            plan = {"source_tables": [t.strip() for t in plan["source_silver"].split("+")], **plan}
        missing = [k for k in ("source_tables", "group_by", "aggregations") if k not in plan]
        if missing:
            raise PlanError(f"plan lacks {', '.join(missing)}")
        return cls(
            source_tables=list(plan["source_tables"]),
            group_by=list(plan["group_by"]),
            aggregations=[Aggregate.from_dict(a) for a in plan["aggregations"]],
            joins=[JoinSpec.from_dict(j) for j in plan.get("joins") or []],
            filters=list(plan.get("filters") or []),
            pre_columns=list(plan.get("pre_columns") or []),
            column_aliases=list(plan.get("column_aliases") or []),
            derived_columns=list(plan.get("derived_columns") or []),
            destination=plan.get("destination", "gold"),
        )

    @property
    def fact(self) -> str:
        return (self.joins[0].fact if self.joins else None) or self.source_tables[0]

    def check(self, tables: dict) -> None:
        """Rules that need only the plan and the table names."""
        if not re.fullmatch(r"\w+", self.destination):
            raise PlanError(f"destination {self.destination!r} is not a plain table name")
        for name in [self.fact, *(j.dim for j in self.joins)]:
            if name not in tables:
                raise PlanError(f"unknown table {name!r}; there are {sorted(tables)}")
        for join in self.joins:
            if join.type not in JOIN_TYPES:
                raise PlanError(
                    f"join type {join.type!r} with {join.dim!r}: only {' and '.join(JOIN_TYPES)} "
                    "keep every fact row"
                )
        for agg in self.aggregations:
            if agg.func not in FUNCTIONS:
                raise PlanError(f"unknown function {agg.func!r} for {agg.alias!r}")
            if agg.func == "RATIO" and not agg.den:
                raise PlanError(f"{agg.alias!r}: RATIO needs den")
            if agg.col == "*" and agg.func != "COUNT":
                raise PlanError(f"{agg.alias!r}: only COUNT takes *")
        names = self.group_by + [a.alias for a in self.aggregations]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise PlanError(f"output names used twice: {twice}")


def plans_of(document: dict) -> list[GoldPlan]:
    """The plans of a planning document: one joined plan if its join is confirmed, else one per
    table. A bare plan is a document of one."""
    if "tables" not in document:
        return [GoldPlan.from_dict(document)]
    if (document.get("cross_table_hint") or {}).get("join_confirmed"):
        return [plan_from_hint(document)]
    return [GoldPlan.from_dict(t) for t in document["tables"]]


def plan_from_hint(plan: dict) -> GoldPlan:
    """A two-table plan from a confirmed join hint and the plans of the single tables.

    Group-by columns and aggregates of all table plans are put together, each name once;
    COUNT always counts rows. The key is the one a join spec for this pair of tables names,
    else the hint's.
    """
    hint = plan.get("cross_table_hint") or {}
    tables, dest = hint.get("tables") or [], hint.get("destination")
    if not hint.get("join_confirmed"):
        raise PlanError("the join hint is not confirmed")
    if len(tables) < 2:
        raise PlanError("a joined plan needs two tables")
    pair = set(tables[:2])
    specs = [j for t in plan.get("tables", []) for j in t.get("joins", []) if j.get("on")]
    named = {j["on"] for j in specs if {j.get("fact", tables[0]), j.get("dim", tables[1])} == pair}
    if len(named) > 1:
        raise PlanError(f"join specs name different keys: {sorted(named)}")
    key = next(iter(named), hint.get("suggested_join_key"))
    if not key or not dest:
        raise PlanError("a joined plan needs a join key and a destination")
    group_by: list[str] = []
    aggregations: dict[str, Aggregate] = {}
    for table in plan.get("tables", []):
        group_by += [c for c in table.get("group_by", []) if c not in group_by]
        for d in table.get("aggregations", []):
            agg = Aggregate.from_dict(d)
            if agg.func == "COUNT":
                agg = Aggregate("COUNT", "*", agg.alias)
            aggregations.setdefault(agg.alias, agg)
    return GoldPlan(
        source_tables=list(tables),
        group_by=group_by,
        aggregations=list(aggregations.values()),
        joins=[JoinSpec(tables[1], key, "left", tables[0])],
        filters=[f for t in plan.get("tables", []) for f in t.get("filters", [])],
        derived_columns=[c for t in plan.get("tables", []) for c in t.get("derived_columns", [])],
        destination=dest,
    )
