"""Expressions the plans use beyond the plain SQL ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def flag(cond: Column) -> Column:
    """A condition as a boolean that is never NULL."""
    return F.coalesce(cond, F.lit(False))
