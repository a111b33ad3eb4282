"""The thirteen declared types: Spark types, literal checks, text forms."""

from __future__ import annotations

import datetime as dt
from enum import Enum
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Kind(Enum):
    CHAR = "Char"
    VARCHAR = "Varchar"
    TEXT = "Text"
    ENUM = "Enum"
    SET = "Set"
    BOOLEAN = "Bool"
    INT = "Int"
    BIGINT = "BigInt"
    FLOAT = "Float"
    DOUBLE = "Double"
    DATE = "Date"
    TIME = "Time"
    DATETIME = "DateTime"


SPARK_TYPES: dict[Kind, T.DataType] = {
    Kind.CHAR: T.StringType(),
    Kind.VARCHAR: T.StringType(),
    Kind.TEXT: T.StringType(),
    Kind.ENUM: T.StringType(),
    Kind.SET: T.ArrayType(T.StringType()),
    Kind.BOOLEAN: T.BooleanType(),
    Kind.INT: T.IntegerType(),
    Kind.BIGINT: T.LongType(),
    Kind.FLOAT: T.FloatType(),
    Kind.DOUBLE: T.DoubleType(),
    Kind.DATE: T.DateType(),
    Kind.TIME: T.TimeType(),
    Kind.DATETIME: T.TimestampNTZType(),
}
STRINGS = (Kind.CHAR, Kind.VARCHAR, Kind.TEXT, Kind.ENUM)
NUMBERS = (Kind.INT, Kind.BIGINT, Kind.FLOAT, Kind.DOUBLE)


def kind_of(spark_type: T.DataType) -> Kind:
    """The declared type that undeclared data of a Spark type gets."""
    for kind in (Kind.VARCHAR, Kind.SET, Kind.BOOLEAN, Kind.INT, Kind.BIGINT, Kind.FLOAT, Kind.DOUBLE, Kind.DATE, Kind.TIME, Kind.DATETIME):
        if SPARK_TYPES[kind].simpleString() == spark_type.simpleString():
            return kind
    raise TypeError(f"no declared type for {spark_type.simpleString()}")


def fits(value: Any, kind: Kind) -> bool:
    """Whether a Python literal is a value of the type; None fits every type."""
    if value is None:
        return True
    if kind in STRINGS:
        return isinstance(value, str) and (kind is not Kind.CHAR or len(value) == 1)
    if kind is Kind.SET:
        return isinstance(value, list | tuple) and all(isinstance(x, str) for x in value)
    if kind is Kind.BOOLEAN:
        return isinstance(value, bool)
    if kind in (Kind.INT, Kind.BIGINT):
        bits = 31 if kind is Kind.INT else 63
        return isinstance(value, int) and not isinstance(value, bool) and -(1 << bits) <= value < 1 << bits
    if kind in (Kind.FLOAT, Kind.DOUBLE):
        return isinstance(value, float)
    if kind is Kind.DATE:
        return isinstance(value, dt.date) and not isinstance(value, dt.datetime)
    return isinstance(value, dt.time if kind is Kind.TIME else dt.datetime)


def shown(value: Any) -> str:
    """A literal with its type, for messages."""
    if isinstance(value, str):
        return 'Varchar("' + value.replace("\\", "\\\\").replace('"', '\\"') + '")'
    names = {bool: "Bool", int: "Int", float: "Double", list: "Set", tuple: "Set", dt.datetime: "DateTime", dt.date: "Date", dt.time: "Time"}
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return "Null" if value is None else f"{names.get(type(value), type(value).__name__)}({text})"


def literal(value: Any, kind: Kind) -> Column:
    if value is None:
        return F.lit(None).cast(SPARK_TYPES[kind])
    if kind is Kind.SET:
        return F.array(*map(F.lit, value)).cast(SPARK_TYPES[kind])
    return F.lit(value).cast(SPARK_TYPES[kind])


def parsed(text: Column, kind: Kind) -> Column:
    """Text as a value of the type; text that isn't one stops the job."""
    t = F.trim(text)
    if kind in (Kind.VARCHAR, Kind.TEXT, Kind.ENUM):
        return text
    if kind is Kind.CHAR:
        return F.when(F.length(text) == 1, text).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a character: "), text)))
    if kind is Kind.SET:
        inner = F.regexp_replace(t, r"^\{|\}$", "")
        parts = F.transform(F.split(inner, ","), lambda x: F.trim(x))
        return F.when(text.isNull(), F.lit(None)).when(inner == "", F.array().cast("array<string>")).otherwise(parts)
    if kind is Kind.BOOLEAN:
        return F.when(t == "true", True).when(t == "false", False).when(text.isNull(), F.lit(None)).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), text)))
    if kind is Kind.DATE:
        return F.to_date(t, "yyyy-MM-dd")
    if kind is Kind.TIME:
        return F.to_time(t, F.lit("HH:mm:ss[.SSSSSS]"))
    if kind is Kind.DATETIME:
        return F.to_timestamp_ntz(t, F.lit("yyyy-MM-dd HH:mm:ss[.SSSSSS]"))
    return t.cast(SPARK_TYPES[kind])


def displayed(c: Column, kind: Kind, null: str | None = "NULL") -> Column:
    """A value as text: sets as {a,b}, null as the given word."""
    text = F.concat(F.lit("{"), F.array_join(c, ","), F.lit("}")) if kind is Kind.SET else c.cast("string")
    return F.coalesce(text, F.lit(null)) if null is not None else text
