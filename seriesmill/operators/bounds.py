"""Facts about each series: its first and last x, its rows and its distinct x values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import free_names, lookup_join
from .normalise import is_valid, key_type, x_key


def x_bounds(df: DataFrame, x: str, dtype: T.DataType, by: Sequence[str] = ()) -> DataFrame:
    """``(by, lo, hi, rows)`` per series in key units; *rows* also counts rows without a valid x."""
    valid = F.when(is_valid(F.col(x), dtype), F.col(x))
    kind = key_type(dtype)
    return df.groupBy(*by).agg(
        x_key(F.min(valid), dtype).cast(kind).alias("lo"),
        x_key(F.max(valid), dtype).cast(kind).alias("hi"),
        F.count(F.lit(1)).alias("rows"),
    )


def with_bounds(df: DataFrame, bounds: DataFrame, by: Sequence[str], only: Row | None = None) -> tuple[DataFrame, Column, Column, list[str]]:
    """*df* with the bounds of its series. A single series gets literals, which fold into plans (*only* is its row, where
    known); several get two columns, whose names come last."""
    if not by:
        row = only or bounds.first()
        kind = bounds.schema["lo"].dataType
        return df, F.lit(row.lo).cast(kind), F.lit(row.hi).cast(kind), []
    names = free_names(["series_lo", "series_hi"], df)
    table = bounds.select(*by, *[F.col(end).alias(name) for end, name in zip(("lo", "hi"), names)])
    return lookup_join(df, table, by), *map(F.col, names), names


def distinct_x(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count_distinct(x).alias("distinct_x"))


def column_profile(df: DataFrame) -> DataFrame:
    """NULL count, minimum, maximum and mean of every column, in one pass.

    Numbers, booleans and durations fill ``min_number``/``max_number``, times and dates
    ``min_time``/``max_time``; ``mean`` is for numbers and booleans.
    """
    from ..sources.schema import kind_of
    from .normalise import plain_value

    aggregates, rows = [], []
    for i, field in enumerate(df.schema.fields):
        kind = kind_of(field.dataType)
        value = F.col(f"`{field.name}`")
        aggregates.append(F.count_if(value.isNull()).alias(f"n{i}"))
        number = time = [f"CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)"]
        time = ["CAST(NULL AS TIMESTAMP_NTZ)", "CAST(NULL AS TIMESTAMP_NTZ)"]
        mean = "CAST(NULL AS DOUBLE)"
        if kind in ("numeric", "boolean", "duration"):
            plain = plain_value(value, field.dataType).cast("double")
            finite = F.nanvl(plain, F.lit(None).cast("double"))
            aggregates += [F.min(finite).alias(f"lo{i}"), F.max(finite).alias(f"hi{i}")]
            number = [f"lo{i}", f"hi{i}"]
            if kind != "duration":
                aggregates.append(F.avg(plain).alias(f"m{i}"))
                mean = f"m{i}"
        elif kind in ("datetime", "date"):
            plain = value.cast("timestamp_ntz")
            aggregates += [F.min(plain).alias(f"lo{i}"), F.max(plain).alias(f"hi{i}")]
            time = [f"lo{i}", f"hi{i}"]
        name = field.name.replace("'", "\\'")
        rows.append(f"'{name}', '{kind}', n{i}, {number[0]}, {number[1]}, {time[0]}, {time[1]}, {mean}")
    names = "column, kind, nulls, min_number, max_number, min_time, max_time, mean"
    return df.agg(*aggregates).select(F.expr(f"stack({len(rows)}, {', '.join(rows)}) AS ({names})"))
