"""Points and rows for display: full rows, or a min/max envelope where one is asked for."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bounds import with_bounds
from ..operators.buckets import points_bucket
from ..operators.display import (
    category_dictionary, encode, envelope, long_points, text_dictionary,
)
from ..operators.normalise import plot_x
from ..operators.order import first_rows, written
from ..operators.ranges import Interval
from ..sources.schema import x_kind_of
from .estimate import estimate_rows
from .job import Job
from .process import Prepared, order_struct, prepare, run


@dataclass
class Points:
    """``points`` is ``(by, series, x, y)``; texts are drawn at the codes of their dictionary."""

    points: DataFrame
    prepared: Prepared
    source: DataFrame
    reduced: bool
    x_categories: DataFrame | None = None
    categories: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def bounds(self) -> DataFrame | None:
        return self.prepared.bounds

    @cached_property
    def rows(self) -> int:
        """The estimated rows of the largest series; computed when asked for."""
        return total_estimate(self.prepared, self.source)


def view_window(view: tuple[float, float] | None, dtype: T.DataType) -> Interval | None:
    """A window given in plot units (epoch seconds for times) in key units."""
    if view is None or x_kind_of(dtype) == "category":
        return None
    if x_kind_of(dtype) == "time":
        return Interval(*(round(end * 1e6) for end in view))
    return Interval(*(float(end) for end in view))


def _prepared(df: DataFrame, job: Job, by, tie, zone, view) -> tuple[Prepared, bool]:
    plain = job.override(ranges=[])
    dtype = df.schema[job.x].dataType if job.x in df.columns else T.LongType()
    window = view_window(view, dtype)
    category = x_kind_of(dtype) == "category"
    prepared = prepare(df, plain, by, tie, zone, need_bounds=not category, window=window, need_y=False)
    return prepared, category


def total_estimate(prepared: Prepared, df: DataFrame) -> int:
    """The largest estimate of any series."""
    if prepared.bounds is None:
        method = prepared.job.aggregation.method
        if method != "per_value":
            rows = df.groupBy(*prepared.by).count().agg(F.max("count")).first()[0] or 0
            return -(-rows // prepared.job.aggregation.n) if method == "every_nth" else rows
    return int(estimate_rows(prepared).agg(F.max("estimate")).first()[0] or 0)


def plot_points(
    df: DataFrame,
    job: Job,
    by: Sequence[str] = (),
    tie: Sequence[str] = ("pos",),
    zone: str | None = None,
    buckets: int | None = None,
    view: tuple[float, float] | None = None,
) -> Points:
    """The points of a plot. The job's ranges are not applied; *view* loads one window of x.

    All points, or with *buckets* the lowest and highest of each of so many buckets (of each category on a text axis).
    """
    prepared, category = _prepared(df, job, by, tie, zone, view)
    by = prepared.by
    result = run(prepared)
    frame, x = result.df, F.col(prepared.x)
    texts: dict[str, list[str]] = {}
    for name, source, function in prepared.outputs:
        if source in prepared.texts and function != "count":
            texts.setdefault(source, []).append(name)
    dictionaries = {source: text_dictionary(frame, names, by) for source, names in texts.items()}
    x_categories = None
    if category:
        position = F.col(result.order[0]) if job.bucketed else order_struct(prepared)
        x_categories = category_dictionary(frame, prepared.x, position, by)
        frame = encode(frame, prepared.x, x_categories, by, "bigint")
    for source, names in texts.items():
        for name in names:
            frame = encode(frame, name, dictionaries[source], by)
    dtype = T.LongType() if category else prepared.dtype
    outputs = [name for name, _, _ in prepared.outputs]
    if buckets is None:
        points = long_points(frame, by, plot_x(x, dtype), outputs)
        return Points(points, prepared, df, False, x_categories, dictionaries)
    if category:
        # One bucket per category position.
        points = envelope(frame, by, x, x.cast("double"), outputs)
        return Points(points, prepared, df, True, x_categories, dictionaries)
    lo, hi = prepared.lo, prepared.hi
    if by and not set(prepared.carried) <= set(frame.columns):  # bucketed rows no longer carry their series' bounds
        frame, lo, hi, _ = with_bounds(frame, prepared.bounds, by)
    if prepared.intervals:
        lo, hi = (F.lit(end).cast(prepared.bounds.schema["lo"].dataType) for end in (prepared.intervals[0].lo, prepared.intervals[0].hi))
    bucket = points_bucket(x, prepared.dtype, buckets, False, lo, hi)
    points = envelope(frame, by, bucket, plot_x(x, dtype), outputs)
    return Points(points, prepared, df, True, None, dictionaries)


@dataclass
class Table:
    """The first rows of a result, with original types."""

    rows: DataFrame
    truncated: bool
    windowed: bool
    estimate: int


def table_rows(
    df: DataFrame, job: Job, tie: Sequence[str] = ("pos",), zone: str | None = None, *, limit: int,
    view: tuple[float, float] | None = None, by: Sequence[str] = (),
) -> Table:
    """The first *limit* processed rows of an x window, and whether there are more."""
    prepared, category = _prepared(df, job, by, tie, zone, view)
    result = run(prepared)
    order = [*by, *result.order]
    # Buckets are computed once; stored rows are read again, up to the cut.
    rows = written(result.df, "buckets") if job.bucketed else result.df
    head = written(first_rows(rows, limit + 1, order), "head")
    count = head.count()
    truncated = count > limit
    estimate = max(total_estimate(prepared, df), count) if truncated else count
    rows = head.orderBy(*order).limit(limit).select(*result.names)
    return Table(rows, truncated, view is not None and not category, estimate)

