"""Ranges of x: resolving, filtering, splitting and measuring them."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.durations import offset_seconds
from ..functions.times import bound_us, from_us, is_instant, time_literal
from ..plans.job import Affine, JobError, Span
from ..sources.schema import kind_of, x_kind_of
from .joins import free_names
from .normalise import INTEGERS, x_key
from .order import ranked

#: Merged ranges that are still tested one by one.
OR_RANGES = 64


@dataclass(frozen=True)
class Interval:
    """A resolved range in key units. Ends are numbers, Columns (per series) or None (open)."""

    lo: Any = None
    hi: Any = None
    label: str = ""


def resolve(spans: Sequence[Span], mode: str, dtype: T.DataType, base: Any, zone: str | None) -> list[Interval]:
    """Ranges of a job in key units; relative ones start at *base* (a number or a Column)."""
    time = x_kind_of(dtype) == "time"
    zone = (zone or "UTC") if is_instant(dtype) else None
    out = []
    for position, span in enumerate(spans, 1):
        amounts, ends = [], []
        for value in (span.start, span.end):
            if value is None:
                amount = end = None
            elif mode == "relative":
                try:
                    amount = offset_seconds(value)
                except ValueError as error:
                    raise JobError(f"Range {position}: {error}") from None
                amount = round(amount * 1e6) if time else amount
                end = base + amount
            elif time:
                try:
                    amount = end = bound_us(value, zone)
                except ValueError:
                    raise JobError(f"Cannot read {value!r} as a time; use ISO 8601 such as 2024-01-31T12:00:00") from None
            else:
                try:
                    amount = end = float(value)
                except (TypeError, ValueError):
                    raise JobError(f"The range bound {value!r} is not a number, but the x axis is numeric") from None
            amounts.append(amount)
            ends.append(end)
        if None not in amounts and amounts[1] < amounts[0]:
            raise JobError(f"Range {position}: end is before start")
        out.append(Interval(*ends, span.label or str(position)))
    return out


def _at_least(x: Column, dtype: T.DataType, bound: Any) -> Column:
    if isinstance(bound, Column):
        return x_key(x, dtype) >= bound
    return x >= (time_literal(bound, is_instant(dtype)) if x_kind_of(dtype) == "time" else F.lit(bound))


def _at_most(x: Column, dtype: T.DataType, bound: Any) -> Column:
    if isinstance(bound, Column):
        return x_key(x, dtype) <= bound
    return x <= (time_literal(bound, is_instant(dtype)) if x_kind_of(dtype) == "time" else F.lit(bound))


def inside(x: Column, dtype: T.DataType, interval: Interval) -> Column:
    parts = []
    if interval.lo is not None:
        parts.append(_at_least(x, dtype, interval.lo))
    if interval.hi is not None:
        parts.append(_at_most(x, dtype, interval.hi))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def any_inside(x: Column, dtype: T.DataType, intervals: Sequence[Interval]) -> Column | None:
    """Rows in at least one interval; None when every row is."""
    if not intervals or any(i.lo is None and i.hi is None for i in intervals):
        return None
    return reduce(lambda a, b: a | b, [inside(x, dtype, i) for i in intervals])


def stored_filter(name: str, dtype: T.DataType, affine: Affine | None, intervals: Sequence[Interval]) -> Column | None:
    """A filter on the stored x that keeps at least the rows in *intervals*.

    Catalyst pushes no comparison through an offset or a date cast, so the bounds are converted
    back instead. Callers still filter the converted values exactly.
    """
    kind = kind_of(dtype)
    converted = affine is not None and not affine.identity
    literal = not any(isinstance(end, Column) for i in intervals for end in (i.lo, i.hi))
    if not literal or not (converted or kind == "date") or isinstance(dtype, T.DecimalType):
        return None
    if kind not in ("datetime", "date", "numeric"):
        return None
    stored = []
    for interval in intervals:
        lo, hi = interval.lo, interval.hi
        if kind in ("datetime", "date"):
            back = round(affine.shift * 1e6) if converted else 0
            lo, hi = (None if end is None else end - back for end in (lo, hi))
        else:
            lo, hi = (None if end is None else affine.invert(float(end)) for end in (lo, hi))
            if affine.scale < 0:
                lo, hi = hi, lo
            # Widened, so that rounding cannot lose a row at a bound.
            lo = None if lo is None else lo - 1e-9 * max(1.0, abs(lo))
            hi = None if hi is None else hi + 1e-9 * max(1.0, abs(hi))
            if isinstance(dtype, INTEGERS):
                lo = None if lo is None else math.floor(lo)
                hi = None if hi is None else math.ceil(hi)
        stored.append(Interval(lo, hi))
    x = F.col(name)
    if kind != "date":
        return any_inside(x, dtype, stored)
    days = [Interval(*(None if end is None else end // 86_400_000_000 for end in (i.lo, i.hi))) for i in stored]
    if any(i.lo is None and i.hi is None for i in days):
        return None

    def day(number: int) -> Column:
        return F.date_from_unix_date(F.lit(int(number)))

    terms = []
    for i in days:
        parts = ([x >= day(i.lo)] if i.lo is not None else []) + ([x <= day(i.hi)] if i.hi is not None else [])
        terms.append(reduce(lambda a, b: a & b, parts))
    return reduce(lambda a, b: a | b, terms) if terms else None


def hull_filter(name: str, dtype: T.DataType, affine: Affine | None, intervals: Sequence[Interval], bounds: DataFrame) -> Column | None:
    """A filter on the stored x that keeps at least the rows in *intervals*, whose ends use columns of *bounds* (a row per series).

    The ends of all series' ranges have one hull. It is a scalar subquery, which Spark computes before the scan and pushes into it, so
    that row groups and files outside are not read. Callers still filter exactly, series by series.
    """
    kind = kind_of(dtype)
    if kind not in ("datetime", "date", "numeric") or isinstance(dtype, T.DecimalType) or not intervals:
        return None
    ends = {"lo": [i.lo for i in intervals], "hi": [i.hi for i in intervals]}
    flipped = kind == "numeric" and affine is not None and affine.scale < 0
    tests = []
    for side, values in ends.items():
        if any(value is None for value in values):
            continue
        columns = [_column(value) for value in values]
        pick = F.least if side == "lo" else F.greatest
        end = pick(*columns) if len(columns) > 1 else columns[0]
        low = (side == "lo") != flipped
        # Of two shapes: Spark merges subqueries of one shape into a struct, whose fields it does not push into scans.
        if side == "lo":
            table = bounds.agg(F.min(end).alias("end"))
        else:
            table = bounds.select(end.alias("end")).orderBy(F.desc("end")).limit(1)
        table = table.select(_stored_end(F.col("end"), dtype, affine, low).alias("end"))
        tests.append(F.col(name) >= table.scalar() if low else F.col(name) <= table.scalar())
    return reduce(lambda a, b: a & b, tests) if tests else None


def _stored_end(end: Column, dtype: T.DataType, affine: Affine | None, low: bool) -> Column:
    """An end in key units as a stored value, never inside of it."""
    kind = kind_of(dtype)
    converted = affine is not None and not affine.identity
    if kind in ("datetime", "date"):
        us = (end - round(affine.shift * 1e6) if converted else end).cast("bigint")
        return from_us(us, is_instant(dtype)) if kind == "datetime" else F.date_from_unix_date(F.floor(us / 86_400_000_000).cast("int"))
    value = end.cast("double")
    value = affine.invert(value) if converted else value
    room = F.greatest(F.lit(1.0), F.abs(value)) * 1e-9  # rounding cannot lose a row at a bound
    value = value - room if low else value + room
    if not isinstance(dtype, INTEGERS):
        return value
    bits = 8 * {"byte": 1, "short": 2, "integer": 4, "long": 8}[dtype.typeName()]
    furthest = -(1 << bits - 1) if low else (1 << bits - 1) - 1
    whole = (F.floor(value) if low else F.ceil(value)) if bits < 64 else F.rint(value)
    return F.coalesce(whole.try_cast(dtype), F.lit(furthest).cast(dtype))


def split_by_interval(
    df: DataFrame, x: str, dtype: T.DataType, intervals: Sequence[Interval], number: str = "range_no", label: str = "range"
) -> DataFrame:
    """One copy of a row per interval that holds it, with the interval's number and label."""
    keep = any_inside(F.col(x), dtype, intervals)
    df = df if keep is None else df.filter(keep)
    hits = [
        F.when(inside(F.col(x), dtype, i), F.struct(F.lit(n).alias("n"), F.lit(i.label).alias("l")))
        for n, i in enumerate(intervals, 1)
    ]
    exploded = df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return exploded.withColumns({number: F.col("_hit.n"), label: F.col("_hit.l")}).drop("_hit")


def merged(ends: Sequence[tuple[Any, Any]]) -> list[tuple[Any, Any]]:
    """Overlapping (lo, hi) pairs as a sorted list of disjoint ones; None is open."""
    low, high = float("-inf"), float("inf")
    pairs = sorted((low if a is None else a, high if b is None else b) for a, b in ends)
    out: list[list] = []
    for lo, hi in pairs:
        if hi < lo:
            continue
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(lo, hi) for lo, hi in out]


def _between(value: Column, lo: Any, hi: Any) -> Column:
    """Within ends of which infinite ones are open, so that whole numbers are compared as such."""
    tests = [test for end, test in ((lo, value >= F.lit(lo)), (hi, value <= F.lit(hi))) if not (isinstance(end, float) and math.isinf(end))]
    return reduce(lambda a, b: a & b, tests) if tests else value.isNotNull() & ~F.isnan(value.cast("double"))


def filter_by_table(df: DataFrame, x: str, ranges: DataFrame, few: int = OR_RANGES, slices: int | None = None) -> DataFrame:
    """Rows whose number *x* lies in any row of a ranges table ``(lo, hi)``, each row once.

    Up to *few* ranges, once merged, are a pushed-down predicate. More of them are ordered together with the rows along
    x: a row is inside when the furthest end of the ranges that start at or before it reaches it. That is one running maximum,
    and no pairs arise. Their hull is pushed down.
    """
    value = F.col(x)
    head = ranges.select("lo", "hi").limit(few + 1).collect()
    if len(head) <= few:
        disjoint = merged([(row.lo, row.hi) for row in head])
        return df.filter(reduce(lambda a, b: a | b, [_between(value, lo, hi) for lo, hi in disjoint], F.lit(False)))
    # Exact numbers keep their type: doubles are not exact beyond 2^53.
    given = [df.schema[x].dataType, ranges.schema["lo"].dataType, ranges.schema["hi"].dataType]
    exact = [t for t in given if isinstance(t, (*INTEGERS, T.DecimalType))]
    kind = "double"
    if len(exact) == len(given):
        kind = "bigint" if all(isinstance(t, INTEGERS) for t in given) else f"decimal(38,{max(t.scale for t in given if isinstance(t, T.DecimalType))})"
    ends = ranges.select(F.col("lo").cast(kind).alias("lo"), F.col("hi").cast(kind).alias("hi")).filter("lo IS NULL OR hi IS NULL OR lo <= hi")
    hull = ends.agg(F.when(F.count("lo") == F.count("*"), F.min("lo")).alias("lo"), F.when(F.count("hi") == F.count("*"), F.max("hi")).alias("hi")).first()
    df = df.filter(_between(value, *[end if end is not None else sign * float("inf") for end, sign in ((hull.lo, -1), (hull.hi, 1))]))
    at, side, spread, reach, furthest = free_names(["at", "side", "spread", "reach", "furthest"], df)
    # Ranges open below come first of all, those open above reach everything.
    starts = ends.select(F.col("lo").alias(at), F.lit(0).alias(side), F.lit(0).cast("bigint").alias(spread), F.struct(F.col("hi").isNull().alias("all"), F.col("hi").alias("to")).alias(reach))
    # Rows with equal x may go to different slices, told apart by a hash.
    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() not in ("array", "map", "struct")]
    keyed = df.withColumns({at: value.cast(kind), side: F.lit(1), spread: F.xxhash64(*plain)}).filter(F.col(at).isNotNull())
    if kind == "double":
        keyed = keyed.filter(~F.isnan(at))
    # NULL starts sort before all rows.
    cut = ranked(keyed.unionByName(starts, allowMissingColumns=True), [], [at, side, spread], slices)
    earlier = F.max(furthest).over(cut.border_window.rowsBetween(Window.unboundedPreceding, -1))
    placed = cut.carry(cut.borders(F.max(reach).alias(furthest)).select(cut.slice, earlier.alias(furthest)))
    best = F.greatest(F.max(reach).over(cut.window.rowsBetween(Window.unboundedPreceding, 0)), F.col(furthest))
    placed = placed.withColumn(reach, best)
    return placed.filter((F.col(side) == 1) & (F.col(f"{reach}.all") | (F.col(f"{reach}.to") >= F.col(at)))).select(*[f"`{c}`" for c in df.columns])


# -- measures -------------------------------------------------------------------------


def span_of(intervals: Sequence[Interval], lo: Column, hi: Column) -> tuple[Column, Column]:
    """The hull of the intervals clipped to the data; NULLs where they do not meet."""
    if not intervals:
        return lo, hi
    starts = [lo if i.lo is None else _column(i.lo) for i in intervals]
    ends = [hi if i.hi is None else _column(i.hi) for i in intervals]
    first = F.greatest(F.least(*starts) if len(starts) > 1 else starts[0], lo)
    last = F.least(F.greatest(*ends) if len(ends) > 1 else ends[0], hi)
    return F.when(first <= last, first), F.when(first <= last, last)


def covered_share(intervals: Sequence[Interval], lo: Column, hi: Column) -> Column:
    """The share of the data's x span that the intervals cover; overlaps count twice, capped at 1."""
    if not intervals:
        return F.when(lo.isNull(), 0.0).otherwise(1.0)
    lengths = []
    for i in intervals:
        start = lo if i.lo is None else F.greatest(lo, _column(i.lo))
        end = hi if i.hi is None else F.least(hi, _column(i.hi))
        lengths.append(F.greatest((end - start).cast("double"), F.lit(0.0)))
    share = reduce(lambda a, b: a + b, lengths) / (hi - lo)
    return F.when(lo.isNull(), 0.0).when(hi <= lo, 1.0).otherwise(F.least(F.lit(1.0), share))


def _column(value: Any) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def rescaled(ranges: DataFrame, old: Affine | None, new: Affine | None) -> DataFrame:
    """Range ends moved from the x units of one scaling to those of another."""
    out = {}
    for end in ("lo", "hi"):
        value = F.col(end)
        value = old.invert(value) if old else value
        out[end] = new.apply(value) if new else value
    return ranges.withColumns(out)


def to_relative(lo: Column, hi: Column, base: Column) -> tuple[Column, Column]:
    """Plot-unit ends as offsets from the first x, to six digits."""
    return F.round(lo - base, 6), F.round(hi - base, 6)
