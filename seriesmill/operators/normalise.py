"""Typed, scaled columns: what every later step works on."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import is_instant, shift, time_literal, to_us
from ..plans.job import Affine
from ..sources.schema import kind_of, x_kind_of

INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def interval_seconds(value: Column) -> Column:
    """A day-time interval as float seconds."""
    return to_us(time_literal(0) + value) / F.lit(1e6)


def plain_value(value: Column, dtype: T.DataType) -> Column:
    """Dates become times, durations seconds, decimals doubles; the rest stays."""
    kind = kind_of(dtype)
    if kind == "date":
        return value.cast("timestamp_ntz")
    if kind == "duration":
        return interval_seconds(value)
    if isinstance(dtype, T.DecimalType):
        return value.cast("double")
    if kind == "text":
        return value.cast("string")
    return value


def scaled_value(value: Column, dtype: T.DataType, affine: Affine | None) -> Column:
    """*affine* applied to a column that went through :func:`plain_value`."""
    if affine is None or affine.identity:
        return value
    if kind_of(dtype) in ("datetime", "date"):
        return shift(value, round(affine.shift * 1e6), is_instant(dtype))
    value = value.cast("double")
    if affine.scale != 1:
        value = value * F.lit(float(affine.scale))
    return value + F.lit(affine.shift) if affine.shift else value


def normalise(
    df: DataFrame, columns: Sequence[str], scaling: dict[str, Affine], keep: Sequence[str] = ()
) -> DataFrame:
    """Select *columns*, typed and scaled, next to *keep* (series and tie-break columns)."""
    out = [F.col(name) for name in keep if name not in columns]
    for name in dict.fromkeys(columns):
        dtype = df.schema[name].dataType
        out.append(scaled_value(plain_value(F.col(name), dtype), dtype, scaling.get(name)).alias(name))
    return df.select(*out)


def is_valid(x: Column, dtype: T.DataType) -> Column:
    """Rows whose x is neither NULL nor NaN."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return x.isNotNull() & ~F.isnan(x)
    return x.isNotNull()


def x_key(x: Column, dtype: T.DataType) -> Column:
    """x as the number that bounds, offsets and widths use: microseconds for times, else x."""
    return to_us(x, is_instant(dtype)) if x_kind_of(dtype) == "time" else x


def key_type(dtype: T.DataType) -> str:
    return "bigint" if x_kind_of(dtype) == "time" or isinstance(dtype, INTEGERS) else "double"


def plot_x(x: Column, dtype: T.DataType) -> Column:
    """x as drawn: epoch seconds for times, a double for numbers."""
    if x_kind_of(dtype) == "time":
        return x_key(x, dtype) / F.lit(1e6)
    return x.cast("double")
