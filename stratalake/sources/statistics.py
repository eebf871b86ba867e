"""Statistics of columns: taken while a load is written, kept in its manifest, merged over segments.

Of every column with plain values: the number of non-null ones, the least and the greatest as text (of strings, of their first characters) and a
HyperLogLog sketch of the distinct ones. All merge, so a table's statistics need none of its rows.
"""

from __future__ import annotations

import base64
import datetime as dt
from collections.abc import Collection
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.schema import is_numeric, is_temporal

#: A sketch has 2^SKETCH_BITS bytes and errs by about 3 percent. Strings are compared by so many characters.
SKETCH_BITS = 10
LEADING = 64


def _has_statistics(dtype: T.DataType) -> bool:
    return is_numeric(dtype) or is_temporal(dtype) or isinstance(dtype, (T.StringType, T.BooleanType))


def metrics(schema: T.StructType, wanted: bool | Collection[str] = True) -> list[Column]:
    """What to observe of each column, or of the wanted ones."""
    out = []
    for i, f in enumerate(schema.fields):
        if not _has_statistics(f.dataType) or wanted is not True and f.name not in (wanted or ()):
            continue
        column = F.col(f"`{f.name.replace('`', '``')}`")
        value = F.substring(column, 1, LEADING) if isinstance(f.dataType, T.StringType) else column
        if isinstance(f.dataType, T.TimestampType):
            value = F.unix_micros(column)  # the same in any session time zone
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            value = F.when(~F.isnan(column), column)
        whole = column if isinstance(f.dataType, T.StringType) else value
        hashed = F.when(whole.isNotNull(), F.xxhash64(whole))  # the sketch would pass over empty strings
        out += [
            F.count(column).alias(f"n{i}"),
            F.min(value).cast("string").alias(f"lo{i}"),
            F.max(value).cast("string").alias(f"hi{i}"),
            F.hll_sketch_agg(hashed, SKETCH_BITS).alias(f"h{i}"),
        ]
    return out


def collected(schema: T.StructType, found: dict) -> dict[str, dict]:
    """The observed values, ready for JSON."""
    out = {}
    for i, f in enumerate(schema.fields):
        if f"n{i}" in found:
            sketch = found[f"h{i}"]
            out[f.name] = {"n": found[f"n{i}"], "min": found[f"lo{i}"], "max": found[f"hi{i}"], "sketch": base64.b64encode(sketch).decode() if sketch else None}
    return out


def _comparable(text: str, dtype: T.DataType):
    if is_numeric(dtype):
        return Decimal(text)
    return int(text) if isinstance(dtype, T.TimestampType) else text.encode()


def merge_statistics(parts: list[dict[str, dict]], types: dict[str, T.DataType]) -> dict[str, dict]:
    """Of several segments together. Sketches are put side by side; a catalog unites them."""
    out: dict[str, dict] = {}
    for name, dtype in types.items():
        if not _has_statistics(dtype):
            continue
        found = [p[name] for p in parts if name in p]
        if not found:
            continue
        low = [f["min"] for f in found if f["min"] is not None]
        high = [f["max"] for f in found if f["max"] is not None]
        sketches = sorted({s for f in found for s in (f["sketch"] or "").split() if s})
        out[name] = {
            "n": sum(f["n"] for f in found),
            "min": min(low, key=lambda v: _comparable(v, dtype), default=None),
            "max": max(high, key=lambda v: _comparable(v, dtype), default=None),
            "sketch": " ".join(sketches) or None,
        }
    return out


def bound(text: str | None, dtype: T.DataType) -> str | None:
    """A least or greatest value for people: timestamps as such, in UTC."""
    if text is not None and isinstance(dtype, T.TimestampType):
        return str(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(text)))
    return text
