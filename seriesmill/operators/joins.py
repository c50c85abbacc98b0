"""Joins with derived tables, and names that no column of a frame has."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(names: Sequence[str], *frames: DataFrame) -> list[str]:
    """*names*, lengthened where a column of *frames* has them already (in any case)."""
    taken = {column.lower() for frame in frames for column in frame.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _matches(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    return reduce(lambda a, b: a & b, [left[a].eqNullSafe(right[b]) for a, b in pairs])


def lookup_join(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Add the columns of *table* (unique in *on*) to *df*; NULL keys match each other.

    An equi-join that adaptive execution plans by the size in bytes of *table*: a broadcast below Spark's threshold, else
    a shuffle whose hot keys it splits. Nothing is computed before the query runs. Without keys, *table* is one row.
    """
    names = free_names([f"{name}_of" for name in on], df, table)
    right = table.withColumnsRenamed(dict(zip(on, names)))
    if not on:
        return df.join(F.broadcast(right), how=how, on=F.lit(True))
    return df.join(right, _matches(df, right, list(zip(on, names))), how).drop(*names)
