"""Plan aggregates as Spark expressions, whole or in two steps.

Each aggregate is built from parts (sums, counts, minima, maxima). The parts can be taken in
one aggregate over joined rows, or first over the rows of single tables per join key and then
put together after the join. Both ways give the same answer; the second joins far fewer rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.schema import is_numeric

FUNCTIONS = ("COUNT", "SUM", "AVG", "MIN", "MAX", "COUNT_DISTINCT", "RATIO", "COUNT_IF", "RATE")

ROWS = "_rows"

_NAME = re.compile(r"[A-Za-z_]\w*$")
# "SUM" with "a)/sum(b": a ratio of sums whose text was split at its outer brackets.
_SPLIT_RATIO = re.compile(r"([^()]+)\)\s*/\s*sum\s*\(([^()]+)$", re.IGNORECASE)


@dataclass(frozen=True)
class Aggregate:
    """``func`` over ``col``: a column name, an SQL expression or ``*``.

    RATIO is sum(col)/sum(den); COUNT_IF counts rows where the condition ``col`` holds; RATE
    is COUNT_IF per count(den) times 100. ``round`` rounds the result.
    """

    func: str
    col: str
    alias: str
    den: str | None = None
    round: int | None = None

    @classmethod
    def from_dict(cls, d: dict) -> Aggregate:
        func = re.sub(r"\s+", "_", str(d.get("func", "COUNT")).strip().upper())
        col = str(d.get("col", "*")).strip()
        alias = d.get("alias") or f"{func.lower()}_{'all' if col == '*' else col}"
        agg = cls(func, col, alias, d.get("den"), d.get("round"))
        split = _SPLIT_RATIO.match(col)
        if func == "SUM" and split:
            agg = replace(agg, func="RATIO", col=split[1].strip(), den=split[2].strip())
        return agg

    @property
    def inputs(self) -> list[str]:
        return [c for c in (self.col, self.den) if c and c != "*"]

    @property
    def is_opaque(self) -> bool:
        """Aggregates spliced by text (unbalanced brackets) are taken as a whole."""
        return any(c.count("(") != c.count(")") for c in self.inputs)


@dataclass(frozen=True)
class Part:
    kind: str  # sum, count, min or max
    value: Column
    reads: str = ""  # the text of the value; empty when it reads no column

    def whole(self) -> Column:
        return getattr(F, self.kind)(self.value)

    def multiplied(self, value: Column, weight: Column | None) -> Column:
        """Over joined partial rows that stand for ``weight`` rows each (None: one). ``value`` is a partial count for
        counts, else the part's value."""
        if self.kind in ("min", "max"):
            return getattr(F, self.kind)(value)
        total = F.sum(value if weight is None else value * weight)
        return F.coalesce(total, F.lit(0)) if self.kind == "count" else total


def is_name(text: str) -> bool:
    return bool(_NAME.match(text))


def quoted(name: str) -> str:
    """A column name as Spark reads it: in backticks unless it is a plain word."""
    return name if is_name(name) else f"`{name}`"


def text_column(text: str) -> Column:
    return F.col(text) if is_name(text) else F.expr(text)


def _parts(agg: Aggregate, dtype: T.DataType | None) -> tuple[list[Part], Callable[[list[Column]], Column]]:
    x, reads = (F.lit(1), "") if agg.col == "*" else (text_column(agg.col), agg.col)
    if agg.func == "COUNT":
        return [Part("count", x, reads)], lambda c: c[0]
    if agg.func in ("SUM", "MIN", "MAX"):
        return [Part(agg.func.lower(), x, reads)], lambda c: c[0]
    if agg.func == "AVG":
        total = x if isinstance(dtype, T.DecimalType) else x.cast("double")
        return [Part("sum", total, reads), Part("count", x, reads)], lambda c: F.try_divide(c[0], c[1])
    if agg.func == "RATIO":
        return [Part("sum", x, reads), Part("sum", text_column(agg.den), agg.den)], lambda c: F.try_divide(c[0], c[1])
    hit = F.when(x, 1).otherwise(0)
    if agg.func == "COUNT_IF":
        return [Part("sum", hit, reads)], lambda c: c[0]
    if agg.func == "RATE":
        of, den = (F.lit(1), "") if agg.den in (None, "*") else (text_column(agg.den), agg.den)
        return [Part("sum", hit, reads), Part("count", of, den)], lambda c: F.try_divide(c[0], c[1]) * 100
    raise ValueError(f"no parts for {agg.func}")


def _finish(agg: Aggregate, column: Column) -> Column:
    return (F.round(column, agg.round) if agg.round is not None else column).alias(agg.alias)


def whole(agg: Aggregate) -> Column:
    """The aggregate in one step."""
    if agg.is_opaque:
        return _finish(agg, F.expr(f"{agg.func}({agg.col})"))
    if agg.func == "COUNT_DISTINCT":
        return _finish(agg, F.count_distinct(text_column(agg.col)))
    if agg.func == "AVG":
        return _finish(agg, F.avg(text_column(agg.col)))
    parts, combine = _parts(agg, None)
    return _finish(agg, combine([p.whole() for p in parts]))


def parts_of(df: DataFrame, agg: Aggregate) -> tuple[list[Part], Callable[[list[Column]], Column]]:
    """The parts of an aggregate over ``df``, and what makes its result of theirs."""
    parts, combine = _parts(agg, _dtype(df, agg))
    return parts, lambda columns: _finish(agg, combine(columns))


def can_multiply(df: DataFrame, aggs: list[Aggregate]) -> bool:
    """Can every sum be taken as a value times a number of rows without loss? Not for texts taken as a whole, times and
    decimals of more than six places, whose product Spark rounds."""
    if any(a.is_opaque for a in aggs):
        return False
    sums = [p.value for a in aggs if a.func != "COUNT_DISTINCT" for p in parts_of(df, a)[0] if p.kind == "sum"]
    types = [f.dataType for f in df.select(*[v.alias(f"v{i}") for i, v in enumerate(sums)]).schema.fields]
    return all(t.scale <= 6 if isinstance(t, T.DecimalType) else is_numeric(t) or isinstance(t, (T.StringType, T.NullType)) for t in types)


def _dtype(df: DataFrame, agg: Aggregate) -> T.DataType | None:
    if agg.func != "AVG":
        return None
    return df.select(text_column(agg.col)).schema.fields[0].dataType
