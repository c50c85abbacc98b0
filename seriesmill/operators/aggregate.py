"""Bucket aggregates. Everything combines before the shuffle.

What fits fixed-width buffers is one hash aggregate. The other cases would make Spark sort all rows: first and last of texts, or along
an order of several columns, take two stages (:func:`end_values`), the least and greatest text of a group comes from its distinct texts, and medians from counted
cells (:func:`exact_medians`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .joins import free_names, lookup_join
from .order import number_cell, ranked, written

_FLOATS = (T.DoubleType, T.FloatType)
_ANY_WIDTH = (T.StringType, T.BinaryType, T.ArrayType, T.MapType, T.StructType)


def without_nan(value: Column, dtype: T.DataType) -> Column:
    return F.when(~F.isnan(value), value) if isinstance(dtype, _FLOATS) else value


def order_key(order: Sequence[str]) -> Column:
    """One comparable value for the order columns."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def value_column(df: DataFrame, column: str, function: str, key: Column) -> Column:
    """The aggregate *function* of *column*; *key* orders first and last."""
    dtype = df.schema[column].dataType
    value = F.col(column)
    if isinstance(dtype, T.BooleanType):
        value = value.cast("int")
    if function == "mean":
        return F.avg(value)
    if function == "min":
        return F.min(without_nan(value, dtype))
    if function == "max":
        return F.max(without_nan(value, dtype))
    if function == "first":
        return F.min_by(value, key)
    if function == "last":
        return F.max_by(value, key)
    if function == "sum":
        return F.coalesce(F.sum(value), F.lit(0))
    if function == "count":
        return F.count(value)
    return F.stddev_samp(value)


def aggregate(
    df: DataFrame,
    keys: Sequence[str],
    outputs: Sequence[tuple[str, str, str]],
    order: Sequence[str],
    extra: Sequence[Column] = (),
) -> DataFrame:
    """Group by *keys*; *outputs* are ``(name, column, function)``, ordered by *order* for first/last.

    Medians are exact and come from :func:`exact_medians`, as Spark's own median holds a group's values in one task.
    """
    medians = [item for item in outputs if item[2] == "median"]
    wide = {name for name in df.columns if isinstance(df.schema[name].dataType, _ANY_WIDTH)}
    one_key = len(order) == 1 and order[0] not in wide
    ends = [item for item in outputs if item[2] in ("first", "last") and not (one_key and item[1] not in wide)]
    texts = [item for item in outputs if item[2] in ("min", "max") and item[1] in wide]
    key = order_key(order)
    apart = [*medians, *ends, *texts]
    inline = [value_column(df, c, f, key).alias(n) for n, c, f in outputs if (n, c, f) not in apart]
    inline += list(extra)
    if ends and order[0] not in wide:
        low, high = free_names(["low", "high"], df)
        edges = [F.min(order[0]).alias(low), F.max(order[0]).alias(high)]
        # Written: the rows meet it, whose size decides how, and the result is not computed twice.
        result = written(df.groupBy(*keys).agg(*inline, *edges), "groups")
        result = end_values(df, keys, ends, order, result, low, high)
    elif ends:
        inline += [value_column(df, c, f, key).alias(n) for n, c, f in ends]
        result = df.groupBy(*keys).agg(*inline)
    else:
        result = df.groupBy(*keys).agg(*inline) if inline else df.select(*keys).distinct()
    if medians:
        result = lookup_join(result, exact_medians(df, keys, [(n, c) for n, c, _ in medians]), keys)
    for name, column, function in texts:
        result = lookup_join(result, end_text(df, keys, column, name, function), keys)
    names = [*keys, *[n for n, _, _ in outputs]]
    return result.select(*names, *[c for c in result.columns if c not in (*names, *([low, high] if ends and order[0] not in wide else []))])


def end_values(
    df: DataFrame, keys: Sequence[str], outputs: Sequence[tuple[str, str, str]], order: Sequence[str], groups: DataFrame, low: str, high: str
) -> DataFrame:
    """*groups* with the *outputs* of their first or last rows along *order*.

    *groups* has the least and greatest value of the first order column. Only rows at these values are ordered by the
    other columns, and every partition keeps one row per group before they meet.
    """
    used = dict.fromkeys([*keys, *order, *[c for _, c, _ in outputs]])
    rows = lookup_join(df.select(*used), groups.select(*keys, low, high), keys, "inner")
    [place] = free_names(["place"], rows)
    for function, edge in (("first", low), ("last", high)):
        mine = [(n, c) for n, c, f in outputs if f == function]
        if not mine:
            continue
        toward = [F.asc(c) if function == "first" else F.desc(c) for c in order[1:]] or [F.lit(0)]
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*toward))
        picked = rows.filter(F.col(order[0]) == F.col(edge)).withColumn(place, number).filter(F.col(place) == 1)
        values = []
        for name, column in mine:
            value = F.col(column)
            values.append((value.cast("int") if isinstance(df.schema[column].dataType, T.BooleanType) else value).alias(name))
        groups = lookup_join(groups, picked.select(*keys, *values), keys)
    return groups


def end_text(df: DataFrame, keys: Sequence[str], column: str, name: str, function: str) -> DataFrame:
    """``(keys, name)``: the least or greatest text of each group, from its distinct texts."""
    [place] = free_names(["place"], df)
    toward = F.asc(column) if function == "min" else F.desc(column)
    texts = df.select(*dict.fromkeys([*keys, column])).filter(F.col(column).isNotNull()).distinct()
    numbered = texts.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(toward)))
    return numbered.filter(F.col(place) == 1).select(*keys, F.col(column).alias(name))


def exact_medians(
    df: DataFrame, keys: Sequence[str], outputs: Sequence[tuple[str, str]], slices: int | None = None
) -> DataFrame:
    """``(keys, names)``: the exact medians of the columns in *outputs* ``(name, column)``, for groups of any size.

    Values are counted in cells along the number line, which combines before the shuffle and leaves at most a million cells of a
    group, whatever its rows. The cells with the middle ranks are read again, equal values counted first, and what is left is
    ordered in slices (:func:`ranked`), so that one group, or all values in one cell, may spread over many tasks. NaN is the
    largest number, as in Spark's median. Groups without a value have no row.
    """
    keys = list(keys)
    taken = ["which", "value", "pair", "cell", "rows", "before", "upto", "lower", "upper"]
    which, value, pair, cell, rows, before, upto, lower, upper = free_names(taken, df)
    columns = list(dict.fromkeys(column for _, column in outputs))
    pairs = []
    for number, column in enumerate(columns):
        plain = F.col(column).cast("int") if isinstance(df.schema[column].dataType, T.BooleanType) else F.col(column)
        pairs.append(F.struct(F.lit(number).alias("n"), plain.cast("double").alias("v")))
    several = df.select(*keys, F.explode(F.array(*pairs)).alias(pair)) if len(pairs) > 1 else df.select(*keys, pairs[0].alias(pair))
    values = several.select(*keys, F.col(f"{pair}.n").alias(which), F.col(f"{pair}.v").alias(value)).filter(F.col(value).isNotNull())
    values = values.withColumn(cell, number_cell(F.col(value)))
    group = [*keys, which]

    series = Window.partitionBy(*group)
    counted = values.groupBy(*group, cell).agg(F.count(F.lit(1)).alias(rows))
    total = F.sum(rows).over(series)
    ranks = counted.select(
        "*", F.sum(rows).over(series.orderBy(cell).rowsBetween(Window.unboundedPreceding, 0)).alias(upto),
        F.floor((total - 1) / 2).alias(lower), F.floor(total / 2).alias(upper),
    )
    middle = ranks.filter((F.col(upto) > F.col(lower)) & (F.col(upto) - F.col(rows) <= F.col(upper)))
    # Ranks from the first value of the first such cell on; there are one or two cells, without values between them.
    base = F.min(F.col(upto) - F.col(rows)).over(series)
    middle = middle.select(*group, cell, (F.col(lower) - base).alias(lower), (F.col(upper) - base).alias(upper))

    near = lookup_join(values, middle, [*group, cell], "inner")
    distinct = near.groupBy(*group, value, lower, upper).agg(F.count(F.lit(1)).alias(rows))
    cut = ranked(distinct, group, [value], slices)
    earlier = F.sum(before).over(cut.border_window.rowsBetween(Window.unboundedPreceding, -1))
    borders = cut.borders(F.sum(rows).alias(before)).select(*group, cut.slice, F.coalesce(earlier, F.lit(0)).alias(before))
    running = F.sum(rows).over(cut.window.rowsBetween(Window.unboundedPreceding, 0))
    placed = cut.carry(borders).withColumn(upto, running + F.col(before))

    def at(rank: str) -> Column:
        return F.max(F.when((F.col(upto) > F.col(rank)) & (F.col(upto) - F.col(rows) <= F.col(rank)), F.col(value)))

    found = placed.groupBy(*group).agg(at(lower).alias(lower), at(upper).alias(upper))
    halves = F.when(F.col(lower) == F.col(upper), F.col(lower)).otherwise(F.col(lower) / 2 + F.col(upper) / 2)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col(which) == columns.index(c), halves)).alias(n) for n, c in outputs])
