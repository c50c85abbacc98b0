"""Values at given positions: the nearest sample, or the last one at or before the position."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import free_names
from .order import ranked


def _held(
    samples: DataFrame, probes: DataFrame, by: Sequence[str], x: str, tie: str, value: str, probe_id: str,
    both_sides: bool, slices: int | None,
) -> DataFrame:
    """Probe rows (by, x, tie) with ``before`` (and ``after``): the neighbouring samples as (x, v) structs."""
    by = list(by)
    at, kind, order, sample, before, after = free_names(["at", "kind", "order", "sample", "before", "after"], samples, probes)
    left = samples.select(*by, F.col(x).alias(at), F.lit(1).alias(kind), F.col(tie).cast("bigint").alias(order), F.struct(F.col(x).alias("x"), F.col(value).alias("v")).alias(sample))
    right = probes.select(*by, F.col(x).alias(at), F.lit(0 if both_sides else 2).alias(kind), F.col(probe_id).cast("bigint").alias(order))
    cut = ranked(left.unionByName(right, allowMissingColumns=True), by, [at, kind, order], slices)
    known = F.when(F.col(sample).isNotNull(), F.col(cut.place))
    tail, head = free_names(["tail", "head"], cut.df)
    past = Window.unboundedPreceding, -1
    edges = [F.max_by(sample, known).alias(tail), *([F.min_by(sample, known).alias(head)] if both_sides else [])]
    carried = [F.last(tail, ignorenulls=True).over(cut.border_window.rowsBetween(*past)).alias(tail)]
    if both_sides:
        later = Window.partitionBy(*by).orderBy(F.desc(cut.slice)).rowsBetween(*past)
        carried.append(F.last(head, ignorenulls=True).over(later).alias(head))
    rows = cut.carry(cut.borders(*edges).select(*by, cut.slice, *carried))
    rows = rows.withColumn(before, F.coalesce(F.last(sample, ignorenulls=True).over(cut.window.rowsBetween(*past)), F.col(tail)))
    found = [F.col(before).alias("before")]
    if both_sides:
        # Looking ahead is looking back along the reversed order: a running frame, linear in the rows.
        reverse = Window.partitionBy(*by, cut.slice).orderBy(F.desc(cut.place)).rowsBetween(*past)
        rows = rows.withColumn(after, F.coalesce(F.last(sample, ignorenulls=True).over(reverse), F.col(head)))
        found.append(F.col(after).alias("after"))
    return rows.filter(F.col(kind) != 1).select(*by, F.col(order).alias(probe_id), F.col(at).alias(x), F.struct(*found).alias("near"))


def lookup_hold(
    samples: DataFrame, probes: DataFrame, by: Sequence[str], x: str, tie: str, value: str, probe_id: str,
    slices: int | None = None,
) -> DataFrame:
    """``(by, probe_id, x, sample_x, value)``: the last sample at or before each probe, else NULL."""
    rows = _held(samples, probes, by, x, tie, value, probe_id, False, slices)
    return rows.select(*by, probe_id, x, F.col("near.before.x").alias("sample_x"), F.col("near.before.v").alias("value"))


def lookup_nearest(
    samples: DataFrame, probes: DataFrame, by: Sequence[str], x: str, tie: str, value: str, probe_id: str,
    distance_key=None, slices: int | None = None,
) -> DataFrame:
    """The sample nearest to each probe; the earlier one at equal distance.

    *distance_key* turns x into a number (for times).
    """
    number = distance_key or (lambda column: column)
    rows = _held(samples, probes, by, x, tie, value, probe_id, True, slices)
    here, earlier, later = number(F.col(x)), F.col("near.before"), F.col("near.after")
    ahead, behind = number(later["x"]) - here, here - number(earlier["x"])
    pick = F.when(later.isNotNull() & (earlier.isNull() | (ahead < behind)), later).otherwise(earlier)
    return rows.select(*by, probe_id, x, pick["x"].alias("sample_x"), pick["v"].alias("value"))
