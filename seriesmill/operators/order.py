"""Exact order-dependent work without a single-task window.

Rows are range-partitioned and sorted along ``(series, order columns)`` once and written, each with the slice it lies in and its
place there. That fixes the slices, however often and wherever the rows are read again. Windows then run inside a slice, and what crosses
a slice border comes from a table with one row per slice. A series, or an x value, that holds most of the rows is spread over
many slices, because the order columns end in a unique tie-break. The plan of the rows is evaluated twice: by Spark
for the range borders, and for the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import scratch_folder
from .joins import free_names, lookup_join

#: Bits of the place in a slice, as in Spark's increasing ids.
PLACE_BITS = 33


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """*df* as a table in the session's shared folder, which nothing here deletes."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@dataclass
class Ranked:
    """Written rows with the number of their slice, which grows along ``(by, order)``, and a place that grows inside it."""

    df: DataFrame
    by: list[str]
    order: list[str]
    slice: str
    place: str

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.by, self.slice).orderBy(self.place)

    def borders(self, *aggregates: Column) -> DataFrame:
        """One row per series and slice: at most one per slice beyond one per series."""
        return self.df.groupBy(*self.by, self.slice).agg(*aggregates)

    @property
    def border_window(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(self.slice)

    def carry(self, table: DataFrame) -> DataFrame:
        """Join a table made from :meth:`borders` back onto the rows; written, so that its size decides how."""
        return lookup_join(self.df, written(table, "borders"), [*self.by, self.slice])


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], slices: int | None = None) -> Ranked:
    """Sort *df* into slices. *order* must be unique within a series.

    There are as many slices as Spark takes shuffle partitions for the data, or *slices*.
    """
    by, order = list(by), list(order)
    place, number = free_names(["place", "slice"], df)
    keys = [F.col(f"`{name}`") for name in (*by, *order)]
    spread = df.repartitionByRange(*([slices] if slices else []), *keys).sortWithinPartitions(*keys)
    rows = written(spread.withColumn(place, F.monotonically_increasing_id()), "ranked")
    return Ranked(rows.withColumn(number, F.shiftright(place, PLACE_BITS).cast("int")), by, order, number, place)


def number_rows(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "row_no", slices: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its series, ordered by *order*."""
    cut = ranked(df, by, order, slices)
    first, rows, before = free_names(["first", "rows", "before"], cut.df)
    counts = cut.borders(F.min(cut.place).alias(first), F.count(F.lit(1)).alias(rows))
    earlier = F.sum(rows).over(cut.border_window.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*cut.by, cut.slice, (F.coalesce(earlier, F.lit(0)) - F.col(first)).alias(before))
    return cut.carry(offsets).withColumn(name, F.col(cut.place) + F.col(before)).select(*df.columns, name)


def every_nth(df: DataFrame, n: int, by: Sequence[str], order: Sequence[str], slices: int | None = None) -> DataFrame:
    """Rows 0, n, 2n, … of each series."""
    if n == 1:
        return df
    [name] = free_names(["row_no"], df)
    numbered = number_rows(df, by, order, name, slices)
    return numbered.filter(F.pmod(name, F.lit(n)) == 0).drop(name)


def first_rows(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """The first *n* rows along *order*, NULLs first.

    Spark's top-n brings *n* rows of every partition to one task. Where *order* starts with a number or a time, a cut keeps them
    away: rows are counted in cells of that column, which are finest near its least value, and the rows beyond the cell with row *n* are
    filtered out, in the scan where that column is stored. The cut is a scalar subquery, so nothing runs before the query. It passes
    about 0.3 % more than *n* rows, and those that share their value with the last.
    """
    dtype = df.schema[order[0]].dataType
    if isinstance(dtype, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)):
        value = F.col(order[0])
        df = df.filter((value <= _cut(df.select(order[0]), n, dtype).scalar()) | value.isNull())
    return df.orderBy(*order).limit(n)


def _cut(values: DataFrame, n: int, dtype: T.DataType) -> DataFrame:
    """One row: a value of the only column that at least *n* rows do not exceed, or its greatest."""
    value = values[values.columns[0]]
    key = value.cast("double") if isinstance(dtype, T.NumericType) else F.unix_micros(value.cast("timestamp")).cast("double")
    keyed = values.select(value.alias("value"), key.alias("key"))
    least = keyed.agg(F.min("key").alias("least")).scalar()
    away = F.when(F.col("key") == least, 0.0).otherwise(F.col("key") - least)
    cells = keyed.groupBy(F.coalesce(number_cell(away), F.lit(-1)).alias("cell")).agg(F.count(F.lit(1)).alias("rows"), F.max("value").alias("value"))
    upto = F.sum("rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))  # a million cells at most
    reached = cells.select("value", upto.alias("upto"))
    return reached.agg(F.coalesce(F.min(F.when(F.col("upto") >= n, F.col("value"))), F.max("value")).alias("cut"))


def number_cell(value: Column) -> Column:
    """A whole number that never falls as the double *value* grows; values of one cell differ by less than 0.3 %."""
    size = F.floor((F.least(F.log2(F.abs(value)), F.lit(1100.0)) + 1100) * 256)
    return F.when(F.isnan(value), F.lit(1 << 30)).when(value == 0, F.lit(0)).otherwise(size * F.signum(value)).cast("bigint")


def number_table(df: DataFrame, order: Sequence[str], name: str, by: Sequence[str] = ()) -> DataFrame:
    """Positions for a derived table (categories, files), from 0 in each *by*."""
    return number_rows(df, by, order, name)
