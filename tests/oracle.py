"""Compares a query's rows with those of its SQL text in DuckDB."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from stratalake.queries.base import TABLES


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _sorted(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]

    def key(row):
        exact = [(v is not None, str(v)) for v in row if not isinstance(v, float)]
        return exact, [f"{v:.6e}" for v in row if isinstance(v, float)]

    return sorted(plain, key=key)


def _same(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, (int, float)):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def differences(df, con, sql: str) -> list[str]:
    """Empty when names, row count and values agree (sums of doubles up to their rounding)."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    expected = result.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} != {sorted(names)}"]
    got = _sorted([tuple(r) for r in df.collect()], df.columns)
    want = _sorted(expected, names)
    if len(got) != len(want):
        return [f"{len(got)} rows != {len(want)}"]
    off = [
        f"{g} != {w}"
        for g, w in zip(got, want, strict=True)
        if not all(_same(x, y) for x, y in zip(g, w, strict=True))
    ]
    return [f"{len(off)} rows differ, first: {off[0]}"] if off else []
