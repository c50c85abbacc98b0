"""Bucket expressions: calendar intervals, numeric steps and a target number of points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.times import fixed_bucket_us, from_us, is_instant, month_bucket, to_us, zoned_bucket
from ..plans.checks import interval_of
from ..sources.schema import x_kind_of
from .normalise import INTEGERS

# Fixed value: the first Monday after 1970-01-01, where week buckets start.
MONDAY_US = 4 * 86_400_000_000


def interval_bucket(x: Column, dtype: T.DataType, every: str | float, scaled: bool, zone: str | None) -> Column:
    """Start of the fixed-interval bucket of x; *scaled* x values are doubles."""
    unit, size = interval_of(every, dtype)
    if unit == "number":
        if isinstance(dtype, INTEGERS) and not scaled and float(size).is_integer():
            return x - F.pmod(x, F.lit(int(size)))
        # floor gives a BIGINT; from 2^53 on doubles are whole, and infinities stay what they are.
        steps = x / F.lit(float(size))
        return F.when(F.abs(steps) < float(1 << 53), F.floor(steps).cast("double")).otherwise(steps) * F.lit(float(size))

    def truncate(wall: Column) -> Column:
        if unit == "months":
            return month_bucket(wall, int(size))
        return from_us(fixed_bucket_us(to_us(wall), int(size), MONDAY_US if unit == "weeks" else 0))

    if is_instant(dtype):
        return zoned_bucket(x, zone or "UTC", truncate)
    return truncate(x)


def points_bucket(x: Column, dtype: T.DataType, points: int, scaled: bool, lo: Column, hi: Column) -> Column:
    """Start of one of *points* equal-width buckets between *lo* and *hi* (key units)."""
    time = x_kind_of(dtype) == "time"
    if time or (isinstance(dtype, INTEGERS) and not scaled):
        width = F.greatest(F.ceil((hi - lo + 1) / F.lit(points)), F.lit(1)).cast("bigint")
        key = to_us(x, is_instant(dtype)) if time else x
        start = key - F.pmod(key - lo, width)
        return from_us(start, is_instant(dtype)) if time else start
    width = (hi - lo) / F.lit(float(points))
    width = F.when(width == 0, 1.0).otherwise(width)
    index = F.least(F.greatest(F.floor((x - lo) / width), F.lit(0)), F.lit(points - 1))
    return index * width + lo
