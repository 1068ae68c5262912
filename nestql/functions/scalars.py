"""Scalars: their Spark types, coercion of literals and variables, rendering."""

from __future__ import annotations

import datetime as dt
import uuid
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nestql.model import EnumType

SPARK = {
    "SmallInt": T.ShortType(),
    "Int": T.IntegerType(),
    "BigInt": T.LongType(),
    "Boolean": T.BooleanType(),
    "String": T.StringType(),
    "ID": T.StringType(),
    "Float": T.FloatType(),
    "Double": T.DoubleType(),
    "NaiveDateTime": T.TimestampNTZType(),
    "DateTime": T.TimestampType(),
    "Date": T.DateType(),
    "Uuid": T.StringType(),
}
_BITS = {"SmallInt": 15, "Int": 31, "BigInt": 63}


class Unfit(ValueError):
    """A literal that a type doesn't take."""


def spark_type(kind: str | EnumType) -> T.DataType:
    if isinstance(kind, EnumType):
        first = kind.values[0][1]
        return T.StringType() if isinstance(first, str) else T.ShortType()
    if kind.startswith("["):
        return T.ArrayType(spark_type(kind[1:-1]))
    return SPARK[kind]


def scalar_of(data_type: T.DataType) -> str:
    """The scalar that stands for a Spark type."""
    if isinstance(data_type, T.ArrayType):
        return f"[{scalar_of(data_type.elementType)}]"
    for name, kind in SPARK.items():
        if type(kind) is type(data_type):
            return name
    if isinstance(data_type, T.ByteType):
        return "SmallInt"
    raise Unfit(f"Unsupported type: {data_type.simpleString()}")


def coerce(value: Any, token: str, kind: str | EnumType) -> Any:
    """A literal as the Python value that a column of a type is compared with.

    ``token`` is the literal's kind (int, float, string, boolean, enum, list);
    variables have the token of their JSON value.
    """
    if isinstance(kind, EnumType):
        if token in ("enum", "string") and value in dict(kind.values):
            return kind.stored(value)
        raise Unfit(f"{value} isn't a value of {kind.name}")
    if kind.startswith("["):
        if token != "list":
            raise Unfit("a list is due")
        return [coerce(v.value, v.kind, kind[1:-1]) for v in value]
    if kind in _BITS:
        if token == "int" and -(1 << _BITS[kind]) <= value < 1 << _BITS[kind]:
            return value
    elif kind in ("Float", "Double"):
        if token in ("int", "float"):
            return float(value)
    elif kind == "Boolean":
        if token == "boolean":
            return value
    elif kind == "String":
        if token == "string":
            return value
    elif kind == "ID":
        if token in ("string", "int"):
            return str(value)
    elif token == "string":
        try:
            if kind == "Uuid":
                return str(uuid.UUID(value))
            if kind == "Date":
                return dt.datetime.fromisoformat(value).date() if len(value) > 10 else dt.date.fromisoformat(value)
            at = dt.datetime.fromisoformat(value)
            if kind == "NaiveDateTime":
                return at.replace(tzinfo=None)
            if kind == "DateTime":
                return at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)
        except ValueError as e:
            raise Unfit(str(e)) from e
    raise Unfit(f"{value!r} isn't a {kind}")


def literal(value: Any, kind: str | EnumType) -> Column:
    """A coerced value as a literal of its column's type, so that scans can push comparisons down."""
    if isinstance(value, list):
        return F.array(*[literal(v, kind[1:-1]) for v in value]).cast(spark_type(kind))
    if isinstance(kind, EnumType):
        return F.lit(value)
    return F.lit(value).cast(spark_type(kind))


def sql_literal(value: Any) -> str:
    """A coerced value in SQL."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, dt.datetime):
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, dt.date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        return "'" + value.replace("'", "''") + "'"
    if isinstance(value, list):
        return "[" + ", ".join(map(sql_literal, value)) + "]"
    if isinstance(value, float):
        return f"CAST({value!r} AS DOUBLE)"
    return str(value)


def rendered(column: Column, kind: str | EnumType) -> Column:
    """A stored value as it is shown: enums by name."""
    if not isinstance(kind, EnumType):
        return column
    out = F.lit(None).cast("string")
    for name, stored in reversed(kind.values):
        out = F.when(column == F.lit(stored), name).otherwise(out)
    return out


def jsonable(value: Any, epoch: bool = False) -> Any:
    """A collected value for JSON: times in ISO format, or as seconds since 1970."""
    if isinstance(value, dict):
        return {k: jsonable(v, epoch) for k, v in value.items()}
    if isinstance(value, list):
        return [jsonable(v, epoch) for v in value]
    if isinstance(value, dt.datetime):
        if epoch:
            return (value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)).timestamp()
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    return value
