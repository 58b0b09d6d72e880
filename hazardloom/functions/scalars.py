"""Scalar expressions over built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_DAY_MICROS = 86_400_000_000


def month_name(date) -> Column:
    """Full English month name."""
    return F.date_format(date, "MMMM")


def whole_days(later, earlier) -> Column:
    """Days between two dates."""
    return F.datediff(later, earlier)


def elapsed_days(later, earlier) -> Column:
    """Whole 24-hour periods between two timestamps, rounded down."""
    return F.floor(F.timestamp_diff("MICROSECOND", earlier, later) / F.lit(_DAY_MICROS)).cast("bigint")


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN in a floating-point column."""
    c = F.col(column)
    return (c.isNull() | F.isnan(c)) if df.schema[column].dataType.typeName() in ("double", "float") else c.isNull()


def number_or_zero(value: Column) -> Column:
    """Text or number as a double; what does not parse, is missing or NaN becomes 0."""
    return F.coalesce(nan_to_null(value.try_cast("double")), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def hash_order(*parts, seed: int) -> Column:
    """Sort key for repeatable random choice: md5 of the parts and the seed."""
    return F.md5(F.concat_ws("|", *[F.col(p).cast("string") if isinstance(p, str) else p for p in parts], F.lit(str(seed))))
