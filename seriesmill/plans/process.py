"""A job as one DataFrame plan over all series at once.

Steps: select, type and scale, drop rows without a valid x, keep the ranges, then raw rows, every
nth row, or buckets. *by* names the series columns (such as the source file); *tie* names the
columns that order rows with equal x and give the file order, the row number by default.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.aggregate import aggregate
from ..operators.bounds import with_bounds, x_bounds
from ..operators.buckets import interval_bucket, points_bucket
from ..operators.joins import free_names
from ..operators.normalise import is_valid, key_type, normalise, x_key
from ..operators.order import every_nth
from ..operators.ranges import Interval, any_inside, hull_filter, resolve, span_of, split_by_interval, stored_filter
from ..sources.schema import kind_of, with_defaults, x_kind_of
from .checks import check_job, interval_of
from .job import ROW_INDEX, Job, JobError


@dataclass
class Prepared:
    """Typed, scaled rows with a valid x, and what is known about them."""

    job: Job
    df: DataFrame
    by: list[str]
    tie: list[str]
    #: Type of the stored x, and of x after typing and scaling.
    stored: T.DataType
    dtype: T.DataType
    zone: str | None
    texts: frozenset[str]
    intervals: list[Interval]
    #: (by, lo, hi, rows) of the whole series, present when a step needs it.
    bounds: DataFrame | None = None
    #: First and last x of the row's series in key units: literals, or columns of *df*.
    lo: Column | None = None
    hi: Column | None = None
    #: The names of those columns.
    carried: Sequence[str] = ()

    @property
    def x(self) -> str:
        return self.job.x

    @property
    def category(self) -> bool:
        return x_kind_of(self.dtype) == "category"

    @property
    def scaled(self) -> bool:
        return self.job.affine(self.x) is not None

    @property
    def outputs(self) -> list[tuple[str, str, str | None]]:
        return self.job.outputs(self.texts)

    @property
    def order(self) -> list[str]:
        """The columns that order rows within a series."""
        in_file_order = self.category or not self.job.sort
        return self.tie if in_file_order else [self.x, *[t for t in self.tie if t != self.x]]


@dataclass
class Processed:
    """Result rows: ``by``, x and the output columns, plus the *order* columns."""

    prepared: Prepared
    df: DataFrame
    by: list[str]
    order: list[str]

    @property
    def names(self) -> list[str]:
        return [*self.by, self.prepared.x, *[name for name, _, _ in self.prepared.outputs]]

    @property
    def frame(self) -> DataFrame:
        return self.df.select(*self.names)

    def sorted(self) -> DataFrame:
        """All result rows in order: a range-partitioned sort."""
        return self.df.orderBy(*self.by, *self.order).select(*self.names)


def with_row_axis(df: DataFrame, job: Job, tie: Sequence[str]) -> DataFrame:
    """Offer the row number as a column under its virtual name."""
    if job.x != ROW_INDEX:
        return df
    if not tie or not isinstance(df.schema[tie[-1]].dataType, (T.LongType, T.IntegerType)):
        raise JobError("The row number axis needs a row number column as the tie-break")
    return df.withColumn(ROW_INDEX, F.col(tie[-1]).cast("bigint"))


def prepare(
    df: DataFrame,
    job: Job,
    by: Sequence[str] = (),
    tie: Sequence[str] = ("pos",),
    zone: str | None = None,
    need_bounds: bool = False,
    window: Interval | None = None,
    need_y: bool = True,
) -> Prepared:
    """Check *job* against *df* and build the filtered, normalised rows.

    *window* replaces the job's ranges (the view of a plot or table). A job without x or y gets those the columns suggest.
    """
    by, tie = list(by), list(tie)
    if not job.x or (need_y and not job.values):
        job = with_defaults(job, df.drop(*by, *tie).schema)
    check_job(job, df.schema, need_y)
    df = with_row_axis(df, job, tie)
    stored = df.schema[job.x].dataType
    scaling = {name: job.scaling[name] for name in [job.x, *job.values] if job.affine(name)}
    texts = frozenset(f.name for f in df.schema.fields if kind_of(f.dataType) == "text")
    relative = job.range_mode == "relative" and bool(job.ranges) and window is None
    needed = relative or need_bounds or job.aggregation.method == "target_points"
    everything = normalise(df, [job.x], scaling, by)
    dtype = everything.schema[job.x].dataType
    bounds = lo = hi = None
    carried: list[str] = []
    if needed:
        bounds = x_bounds(everything, job.x, dtype, by)
        only = None if by else bounds.first()
        df, lo, hi, carried = with_bounds(df, bounds, by, only)
    base: Column | float | None = None
    if relative:
        base = lo if by else only.lo
        if base is None:
            raise JobError("There are no rows with a valid x value")
    intervals = [window] if window else resolve(job.ranges, job.range_mode, dtype, base, zone)
    if relative and by:
        ends = bounds.select(F.col("lo").alias(carried[0]), F.col("hi").alias(carried[1]))
        early = hull_filter(job.x, stored, job.affine(job.x), intervals, ends)
    else:
        early = stored_filter(job.x, stored, job.affine(job.x), intervals)
    if early is not None:
        df = df.filter(early)
    rows = normalise(df, [job.x, *job.values], scaling, [*by, *[t for t in tie if t not in by], *carried])
    rows = rows.filter(is_valid(F.col(job.x), dtype))
    return Prepared(job, rows, by, tie, stored, dtype, zone, texts, intervals, bounds, lo, hi, carried)


def keep_ranges(prepared: Prepared, intervals: Sequence[Interval] | None = None) -> DataFrame:
    intervals = prepared.intervals if intervals is None else intervals
    predicate = any_inside(F.col(prepared.x), prepared.dtype, intervals)
    return prepared.df if predicate is None else prepared.df.filter(predicate)


def run(prepared: Prepared, split: bool = False, slices: int | None = None) -> Processed:
    """Filter, then thin or aggregate. With *split*, each range is a result of its own."""
    job, by = prepared.job, list(prepared.by)
    if split:
        rows = split_by_interval(prepared.df, prepared.x, prepared.dtype, prepared.intervals)
        by += ["range_no", "range"]
    else:
        rows = keep_ranges(prepared)
    method = job.aggregation.method
    if method in ("none", "every_nth"):
        if method == "every_nth":
            rows = every_nth(rows, job.aggregation.n, by, prepared.order, slices)
        return Processed(prepared, rows, by, prepared.order)
    return bucketed(prepared, rows, by, split)


def bucketed(prepared: Prepared, rows: DataFrame, by: list[str], split: bool) -> Processed:
    job, x, agg = prepared.job, F.col(prepared.x), prepared.job.aggregation
    if agg.method == "per_value":
        bucket = x
    elif agg.method == "interval":
        bucket = interval_bucket(x, prepared.stored, agg.every, prepared.scaled, prepared.zone)
    else:
        lo, hi = prepared.lo, prepared.hi
        if split:
            spans = [span_of([i], lo, hi) for i in prepared.intervals]
            lo = F.coalesce(*[F.when(F.col("range_no") == n, s[0]) for n, s in enumerate(spans, 1)])
            hi = F.coalesce(*[F.when(F.col("range_no") == n, s[1]) for n, s in enumerate(spans, 1)])
        else:
            lo, hi = span_of(prepared.intervals, lo, hi)
        bucket = points_bucket(x, prepared.stored, agg.points, prepared.scaled, lo, hi)
    # Grouping uses its own column, because x itself still orders first and last.
    start, appears = free_names(["bucket", "appears"], rows)
    rows = rows.withColumn(start, bucket)
    order = prepared.order
    ends = [column for _, column, function in prepared.outputs if function in ("first", "last")]
    if ends and not any(column in prepared.texts for column in ends):
        rows, order = first_last_order(prepared, rows, start)
    first = [F.min(order_struct(prepared)).alias(appears)] if prepared.category else []
    grouped = aggregate(rows, [*by, start], prepared.outputs, order, first)
    grouped = grouped.withColumnRenamed(start, prepared.x)
    return Processed(prepared, grouped, by, [appears] if prepared.category else [prepared.x])


def first_last_order(prepared: Prepared, rows: DataFrame, bucket: str) -> tuple[DataFrame, list[str]]:
    """Order columns for first and last within a bucket, as one BIGINT where that is exact.

    A struct of x and the tie-break needs a sorting aggregate. Within a bucket, the distance of x
    from the bucket's start and the tie-break often fit 63 bits together, and then a hash
    aggregate does; the range of the tie-break is looked up to know.
    """
    agg, tie = prepared.job.aggregation, prepared.tie
    if agg.method == "per_value":  # x is the same in the whole bucket
        return rows, tie
    whole = prepared.dtype if not isinstance(prepared.dtype, T.TimestampType) else None
    packable = prepared.order != tie and len(tie) == 1 and isinstance(rows.schema[tie[0]].dataType, (T.LongType, T.IntegerType))
    if agg.method != "interval" or whole is None or key_type(whole) != "bigint" or not packable:
        return rows, prepared.order
    unit, size = interval_of(agg.every, prepared.stored)
    width = int(size) * 31 * 86_400_000_000 if unit == "months" else int(size)
    low, high = rows.agg(F.min(tie[0]), F.max(tie[0])).first()
    if low is None or width * (high - low + 1) >= 1 << 63:
        return rows, prepared.order
    start = x_key(F.col(bucket), whole)
    packed = (x_key(F.col(prepared.x), whole) - start) * F.lit(high - low + 1) + (F.col(tie[0]) - F.lit(low))
    [place] = free_names(["place"], rows)
    return rows.withColumn(place, packed), [place]


def order_struct(prepared: Prepared) -> Column:
    """The file position as one value."""
    return F.col(prepared.tie[0]) if len(prepared.tie) == 1 else F.struct(*prepared.tie)


def process(
    df: DataFrame,
    job: Job,
    by: Sequence[str] = (),
    tie: Sequence[str] = ("pos",),
    zone: str | None = None,
    split: bool = False,
    ordered: bool = False,
) -> DataFrame:
    """The rows *job* produces from *df*, with typed values; sorted only when *ordered*."""
    result = run(prepare(df, job, by, tie, zone), split or (job.output.split_ranges and bool(job.ranges)))
    return result.sorted() if ordered else result.frame
