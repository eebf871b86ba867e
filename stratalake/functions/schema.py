"""Rules that look only at a schema: key inference, column roles, canonical casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalake.functions.names import AUDIT_COLUMNS, to_snake_case

# Substrings that rule a name out as a key, and those that mark a
# string column as a date.
_NOT_KEY = ("foreign", "ref")
_DATE_WORDS = ("date", "_at", "_time", "timestamp", "created", "updated", "_day", "_on")

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, _WHOLE + _FRACTION)


def is_whole(dtype: T.DataType) -> bool:
    return isinstance(dtype, _WHOLE)


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, _TEMPORAL)


def is_id_name(name: str) -> bool:
    return name == "id" or name.endswith("_id")


def infer_key(schema: T.StructType) -> str:
    """First ``*_id`` column that is no foreign reference, else ``id``, else the first column.

    The answer is the snake_case name. The rule depends on column order (JSON
    columns come out alphabetically), so every caller takes an override.
    """
    names = [to_snake_case(f.name) for f in schema.fields]
    ids = [n for n in names if n.endswith("_id") and not any(w in n for w in _NOT_KEY)]
    if ids:
        return ids[0]
    return "id" if "id" in names else names[0]


def column_role(name: str, dtype: T.DataType) -> str:
    """audit, id, date, measure or dimension. The type decides before the name does;
    name words count only for strings (``response_time_minutes`` is a measure)."""
    low = name.lower()
    if low.startswith("_"):
        return "audit"
    if is_id_name(low):
        return "id"
    if is_temporal(dtype):
        return "date"
    if is_numeric(dtype):
        return "measure"
    if isinstance(dtype, T.StringType) and any(w in low for w in _DATE_WORDS):
        return "date"
    return "dimension"


def is_audit(name: str) -> bool:
    return name in AUDIT_COLUMNS


def canonical_type(dtype: T.DataType, widen: bool = False, keep_boolean: bool = False) -> T.DataType:
    """Silver type of a Bronze type."""
    if isinstance(dtype, T.LongType):
        return T.LongType() if widen else T.IntegerType()
    if isinstance(dtype, _WHOLE):
        return T.IntegerType()
    if isinstance(dtype, _FRACTION):
        return dtype if widen else T.FloatType()
    if isinstance(dtype, _TEMPORAL):
        return dtype
    if isinstance(dtype, T.BooleanType) and keep_boolean:
        return dtype
    return T.StringType()


def canonical_columns(
    schema: T.StructType,
    widen: bool = False,
    keep_boolean: bool = False,
    nested: str = "string",
) -> list[Column]:
    """One projection that renames to snake_case and casts to the Silver types.

    Casts are plain, so under ANSI a bigint that does not fit an int raises instead
    of wrapping or silently nulling a key; ``widen`` keeps the wide type.
    ``nested`` is ``string`` (Spark's text form) or ``json``.
    """
    if nested not in ("string", "json"):
        raise ValueError(f"nested must be 'string' or 'json', not {nested!r}")
    taken: dict[str, str] = {}
    columns = []
    for field in schema.fields:
        name = to_snake_case(field.name)
        if name in taken:
            raise ValueError(f"columns {taken[name]!r} and {field.name!r} both become {name!r}")
        taken[name] = field.name
        source = F.col(f"`{field.name.replace('`', '``')}`")
        if nested == "json" and isinstance(field.dataType, _NESTED):
            columns.append(F.to_json(source).alias(name))
        else:
            target = canonical_type(field.dataType, widen, keep_boolean)
            columns.append(source.cast(target).alias(name))
    return columns


# Whole numbers in widening order; each step keeps every value.
_WHOLE_ORDER = ["tinyint", "smallint", "int", "bigint"]
# Digits that hold any value of a whole number.
_DIGITS = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 19}


def wider_type(a: T.DataType, b: T.DataType) -> T.DataType | None:
    """The type that holds all values of both, or None when there is none without loss."""
    if a == b:
        return a
    x, y = a.simpleString(), b.simpleString()
    if x in _WHOLE_ORDER and y in _WHOLE_ORDER:
        return a if _WHOLE_ORDER.index(x) > _WHOLE_ORDER.index(y) else b
    if "date" in (x, y) and {x, y} & {"timestamp", "timestamp_ntz"}:  # a day is its midnight
        return b if x == "date" else a
    for whole, decimal in ((x, b), (y, a)):
        if whole in _DIGITS and isinstance(decimal, T.DecimalType):
            digits = max(_DIGITS[whole], decimal.precision - decimal.scale)
            return T.DecimalType(digits + decimal.scale, decimal.scale) if digits + decimal.scale <= 38 else None
    if {x, y} == {"float", "double"} or (y == "double" and x in _WHOLE_ORDER[:3]) or (x == "double" and y in _WHOLE_ORDER[:3]):
        return T.DoubleType()
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        whole = max(a.precision - a.scale, b.precision - b.scale)
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else None
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    return None


def merge_schemas(a: T.StructType, b: T.StructType) -> T.StructType:
    """The columns of ``a``, then those that only ``b`` has, each in the type that holds the values of both; raises if there is none."""
    others = {f.name.lower(): f for f in b.fields}
    fields = []
    for f in a.fields:
        other = others.pop(f.name.lower(), None)
        both = wider_type(f.dataType, other.dataType) if other else f.dataType
        if both is None:
            raise ValueError(f"types differ: {f.name}: {other.dataType.simpleString()} -> {f.dataType.simpleString()}")
        fields.append(T.StructField(f.name, both))
    return T.StructType([*fields, *others.values()])
