"""Naming rules shared by the layers (driver side, no data touched)."""

from __future__ import annotations

import re

AUDIT_COLUMNS = ("_ingestion_timestamp", "_source_name", "_load_mode")
BAD_RECORD = "_corrupt_record"
LOAD_ID = "_load_id"

# The naming rule, two patterns that are applied in this order.
SNAKE_CASE = (r"(.)([A-Z][a-z]+)", r"([a-z0-9])([A-Z])")


def to_snake_case(name: str) -> str:
    """``CustomerID`` -> ``customer_id``; ``HTTPResponseCode`` -> ``http_response_code``.

    A word starts at a capital followed by a lower-case letter, or at a capital
    after a lower-case letter or digit. Spaces stay as they are.
    """
    for pattern in SNAKE_CASE:
        name = re.sub(pattern, r"\1_\2", name)
    return name.lower()


def _strip_layer(name: str) -> str:
    return re.sub(r"_(bronze|silver)$", "", name)


def bronze_name(source: str, kind: str = "file") -> str:
    """``schema.table`` -> ``table_bronze`` (jdbc); ``/dir/file.csv`` -> ``file_bronze`` (file)."""
    if kind == "jdbc":
        return source.split(".")[-1] + "_bronze"
    last = re.split(r"[/\\]", source.rstrip("/\\"))[-1]
    return re.sub(r"(?<=.)\.[^.]*$", "", last) + "_bronze"


def silver_name(bronze: str) -> str:
    return re.sub(r"_bronze$", "", bronze) + "_silver"


def summary_name(table: str) -> str:
    return _strip_layer(table) + "_summary"


def view_name(table: str) -> str:
    return table.replace("-", "_")


def check_table_name(name: str) -> str:
    """Table names become path components, so only word characters and ``-`` are let through."""
    if not re.fullmatch(r"[\w-]+", name):
        raise ValueError(f"not a table name: {name!r}")
    return name
