"""Reductions for display: envelopes, category codes, splices and state steps."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import readout_text
from .joins import free_names, lookup_join
from .order import number_table, ranked, written


def long_points(df: DataFrame, by: Sequence[str], x: Column, outputs: Sequence[str]) -> DataFrame:
    """``(by, series, x, y)``: one row per output value, all as doubles."""
    pairs = F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("y")) for n in outputs])
    rows = df.select(*by, x.alias("x"), F.explode(pairs).alias("_p"))
    return rows.select(*by, "_p.series", "x", "_p.y")


def envelope(
    df: DataFrame, by: Sequence[str], bucket: Column, x: Column, outputs: Sequence[str]
) -> DataFrame:
    """``(by, series, x, y)``: the lowest and the highest value of every bucket, in x order.

    Ties go to the smallest x. Needs no sorted input, and buckets whose values are all missing are left out. Two hash aggregates:
    the extremes of all buckets, written, and then the smallest x of the rows that reach them.
    """
    number, at = free_names(["bucket", "at"], df)
    values = free_names([f"value{i}" for i in range(len(outputs))], df)
    numbers = [F.col(name).cast("double") for name in outputs]
    known = [F.when(~F.isnan(value), value).alias(name) for value, name in zip(numbers, values)]
    rows = df.select(*by, bucket.alias(number), x.alias(at), *known)
    low, high = ([f"{end}{i}" for i in range(len(outputs))] for end in free_names(["low", "high"], rows))
    ends = [f(v).alias(n) for f, names in ((F.min, low), (F.max, high)) for v, n in zip(values, names)]
    extremes = written(rows.groupBy(*by, number).agg(*ends), "extremes")
    met = lookup_join(rows, extremes, [*by, number], "inner")
    tests = {n: F.col(v) == F.col(n) for names in (low, high) for v, n in zip(values, names)}
    places = [F.min(F.when(test, F.col(at))).alias(f"{n}x") for n, test in tests.items()]
    grouped = met.filter(reduce(lambda a, b: a | b, tests.values())).groupBy(*by, number, *low, *high).agg(*places)
    points = []
    for i, name in enumerate(outputs):
        one, other = (F.struct(F.col(f"{n}x").alias("x"), F.col(n).alias("y")) for n in (low[i], high[i]))
        both = F.when(one["x"] <= other["x"], F.array(one, other)).otherwise(F.array(other, one))
        points.append(F.when(F.col(low[i]).isNotNull(), F.struct(F.lit(name).alias("series"), both.alias("points"))))
    found = grouped.select(*by, F.explode(F.array_compact(F.array(*points))).alias("s"))
    found = found.select(*by, "s.series", F.explode("s.points").alias("p"))
    return found.select(*by, "series", "p.x", "p.y")


# -- codes ----------------------------------------------------------------------------


def text_dictionary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by, value, code)``: the distinct texts of *columns* together, sorted, numbered from 0."""
    parts = [df.select(*by, F.col(name).alias("value")) for name in columns]
    values = parts[0]
    for part in parts[1:]:
        values = values.unionByName(part)
    return number_table(values.filter("value IS NOT NULL").distinct(), ["value"], "code", by)


def category_dictionary(df: DataFrame, x: str, position: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(by, value, code)``: the texts of *x* in order of first appearance, numbered from 0."""
    seen = df.groupBy(*by, F.col(x).alias("value")).agg(F.min(position).alias("_appears"))
    return number_table(seen, ["_appears", "value"], "code", by).drop("_appears")


def encode(df: DataFrame, column: str, dictionary: DataFrame, by: Sequence[str] = (), dtype: str = "double") -> DataFrame:
    """Replace *column* by its code; NULL and unknown texts become NULL."""
    codes = dictionary.select(*by, F.col("value").alias(column), F.col("code").alias("_code"))
    joined = lookup_join(df, codes, [*by, column])
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), F.col("_code")).cast(dtype)).drop("_code")


def recode(points: DataFrame, old: DataFrame, new: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Codes ``y`` of *points* moved from one dictionary to another; unknown ones become NULL."""
    keys = [*by, "value"]
    before = old.select(*keys, F.col("code").cast("double").alias("y"))
    after = new.select(*keys, F.col("code").cast("double").alias("_new"))
    table = lookup_join(before, after, keys).select(*by, "y", "_new")
    joined = lookup_join(points, table, [*by, "y"])
    return joined.withColumn("y", F.when(F.col("y").isNotNull(), F.col("_new"))).drop("_new")


def splice(
    overview: DataFrame, detail: DataFrame, lo: float, hi: float, by: Sequence[str] = (), codes: dict[str, tuple[DataFrame, DataFrame]] | None = None
) -> DataFrame:
    """*overview* points with those inside ``[lo, hi]`` replaced by *detail*.

    Series without detail are kept whole; detail of unknown series is dropped. *codes* gives for text series the dictionaries of
    detail and overview: the detail's codes become the overview's, NULL where it has none.
    """
    keys = [*by, "series"]
    outside = (F.col("x") < lo) | (F.col("x") > hi)
    detailed, known = free_names(["detailed", "known"], overview, detail)
    with_detail = detail.select(*keys).distinct().withColumn(detailed, F.lit(True))
    kept = lookup_join(overview, with_detail, keys).filter(F.col(detailed).isNull() | outside).drop(detailed)
    for name, (old, new) in (codes or {}).items():
        mine = F.col("series") == name
        detail = detail.filter(~mine).unionByName(recode(detail.filter(mine), old, new, by).select(*detail.columns))
    added = lookup_join(detail, overview.select(*keys).distinct().withColumn(known, F.lit(True)), keys, how="inner").drop(known)
    return kept.unionByName(added.select(*kept.columns))


# -- steps and summaries ----------------------------------------------------------------


def state_intervals(
    df: DataFrame, by: Sequence[str], x: str, tie: Sequence[str], value: str, slices: int | None = None
) -> DataFrame:
    """``(by, x_start, x_end, value)``: a value holds until the next sample; the last one is open."""
    order = [x, *[t for t in tie if t != x]]
    cut = ranked(df.select(*dict.fromkeys([*by, *order, value])), by, order, slices)
    first, following = free_names(["first", "following"], cut.df)
    after = F.lead(first).over(cut.border_window)
    rows = cut.carry(cut.borders(F.min(x).alias(first)).select(*cut.by, cut.slice, after.alias(following)))
    end = F.coalesce(F.lead(x).over(cut.window), F.col(following))
    return rows.select(*by, F.col(x).alias("x_start"), end.alias("x_end"), F.col(value).alias("value"))


def category_summary(points: DataFrame, by: Sequence[str] = (), texts: dict[str, DataFrame] | None = None) -> DataFrame:
    """Per series and category position: how many finite values, the lowest and the highest.

    *text* says it as shown: the value, or ``low … high (n values)``. Series in *texts* are drawn at the codes of a dictionary
    (by, value, code): their value is its text, several of them are ``n values``.
    """
    finite = F.col("y").isNotNull() & ~F.isnan("y") & (F.abs("y") != float("inf"))
    grouped = points.filter(finite).groupBy(*by, "series", "x").agg(
        F.count(F.lit(1)).alias("values"), F.min("y").alias("low"), F.max("y").alias("high")
    )
    count = F.concat(F.col("values").cast("string"), F.lit(" values"))
    low, high = readout_text(F.col("low")), readout_text(F.col("high"))
    spread = F.concat(low, F.lit(" … "), high, F.lit(" ("), count, F.lit(")"))
    numbers = grouped.withColumn("text", F.when(F.col("values") == 1, low).otherwise(spread))
    if not texts:
        return numbers
    [name] = free_names(["name"], grouped)
    named = numbers.filter(~F.col("series").isin(*texts))
    for series, dictionary in texts.items():
        codes = dictionary.select(*by, F.col("code").cast("double").alias("low"), F.col("value").alias(name))
        rows = lookup_join(grouped.filter(F.col("series") == series), codes, [*by, "low"])
        text = F.when(F.col("values") == 1, F.coalesce(name, F.lit("–"))).otherwise(count)
        named = named.unionByName(rows.withColumn("text", text).drop(name))
    return named


def category_unique(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Whether each series has one row per category, so that it can be drawn as bars."""
    per_x = points.groupBy(*by, "series", "x").agg(F.count(F.lit(1)).alias("_n"))
    return per_x.groupBy(*by, "series").agg((F.max("_n") == 1).alias("single"))
