"""How many rows a job will produce, from counts and bounds alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.bounds import distinct_x
from ..operators.joins import lookup_join
from ..operators.ranges import Interval, covered_share
from ..sources.schema import x_kind_of
from .checks import interval_seconds
from .job import Job
from .process import Prepared, keep_ranges


def estimate_column(job: Job, stored: T.DataType, rows: Column, share: Column, lo: Column, hi: Column, ranges: int) -> Column:
    """The estimate for a method other than per_value; *lo* and *hi* are in key units."""
    kept = rows * share
    agg = job.aggregation
    if agg.method == "every_nth":
        return F.ceil(kept / F.lit(max(1, agg.n))).cast("bigint")
    if agg.method == "target_points":
        return F.least(kept, F.lit(float(agg.points * max(1, ranges)))).cast("bigint")
    if agg.method == "interval":
        unit = 1e6 if x_kind_of(stored) == "time" else 1.0
        span = (hi - lo) / F.lit(unit) * share
        buckets = F.floor(span / F.lit(interval_seconds(agg.every, stored))) + 1 + ranges
        return F.when(lo.isNull(), 0).otherwise(F.least(kept, buckets.cast("double"))).cast("bigint")
    return kept.cast("bigint")


def estimate_rows(prepared: Prepared, intervals: Sequence[Interval] | None = None) -> DataFrame:
    """``(by, estimate)`` per series, for all ranges or the given ones; *prepared* needs its bounds."""
    job, by = prepared.job, prepared.by
    intervals = prepared.intervals if intervals is None else intervals
    lo, hi = F.col("lo"), F.col("hi")
    if job.aggregation.method == "per_value":
        exact = distinct_x(keep_ranges(prepared, intervals), prepared.x, by)
        table = exact.select(*by, F.col("distinct_x").cast("bigint").alias("estimate"))
        if not by:
            return table
        joined = lookup_join(prepared.bounds.select(*by), table, by)
        return joined.withColumn("estimate", F.coalesce("estimate", F.lit(0)))
    bounds = prepared.bounds
    if prepared.carried:  # relative ends are written in terms of the row's series start
        bounds = bounds.withColumns(dict(zip(prepared.carried, (lo, hi))))
    share = covered_share(intervals, lo, hi) if intervals else F.lit(1.0)
    estimate = estimate_column(job, prepared.stored, F.col("rows"), share, lo, hi, len(intervals))
    return bounds.select(*by, estimate.alias("estimate"))
