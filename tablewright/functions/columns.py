"""Small column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def named(name: str) -> Column:
    """A column by its exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_floating(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_instant(kind: T.DataType) -> bool:
    return isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType))


def without_nan(column: Column, kind: T.DataType) -> Column:
    return F.nullif(column, F.lit(float("nan"))) if is_floating(kind) else column


def as_number(column: Column, kind: T.DataType) -> Column | None:
    """A double that orders as the column does (instants and durations as microseconds), or None."""
    if is_numeric(kind) or isinstance(kind, T.BooleanType):
        return (column.cast("int") if isinstance(kind, T.BooleanType) else column).cast("double")
    if is_instant(kind):
        return F.unix_micros(column.cast("timestamp")).cast("double")
    if isinstance(kind, T.DayTimeIntervalType):
        return F.unix_micros(F.expr("timestamp'1970-01-01 00:00:00'") + column).cast("double")
    return None
