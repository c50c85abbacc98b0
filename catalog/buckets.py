"""Buckets and aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill import Job
from seriesmill.operators.aggregate import aggregate
from seriesmill.operators.bounds import x_bounds
from seriesmill.plans.estimate import estimate_rows
from seriesmill.plans.process import prepare

from .base import job_query, numbered, rounded, table


def interval(every, functions=("mean",), **more):
    return {"aggregation": {"method": "interval", "every": every, "functions": list(functions)}, **more}


def points(n, functions=("mean",), **more):
    return {"aggregation": {"method": "target_points", "points": n, "functions": list(functions)}, **more}


EVENTS = {"x": "ts", "y": ["value"]}
ALL = ["mean", "min", "max", "median", "first", "last", "sum", "count", "std"]

ALL_SQL = """
    round(avg(value), 9) AS value_mean, min(value) AS value_min, max(value) AS value_max,
    round(median(value), 9) AS value_median, first(value ORDER BY ts, event_id) AS value_first,
    last(value ORDER BY ts, event_id) AS value_last, round(sum(value), 9) AS value_sum,
    count(value) AS value_count, round(stddev_samp(value), 9) AS value_std
"""


def _estimates(spark, folder):
    """One estimate per method, over the same series and ranges."""
    df = table(spark, folder, "events")
    methods = [
        {"method": "none"}, {"method": "every_nth", "n": 7}, {"method": "interval", "every": "6h"},
        {"method": "target_points", "points": 50}, {"method": "per_value"},
    ]
    out = None
    for agg in methods:
        job = Job.from_dict({**EVENTS, "range_mode": "relative", "ranges": [[0, "3d"], ["5d", "6d"]], "aggregation": agg})
        part = estimate_rows(prepare(df, job, (), ["event_id"], need_bounds=True)).select(F.lit(agg["method"]).alias("method"), "estimate")
        out = part if out is None else out.unionByName(part)
    return out


def _median_split(spark, folder):
    """Medians by rank, as used when a group is too large for one task."""
    df = table(spark, folder, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("price"), "l_orderkey")
    result = aggregate(df, ["l_returnflag"], [("price_median", "price", "median"), ("price_count", "price", "count")], ["l_orderkey"])
    return rounded(result, 6)


def _bounds(spark, folder):
    df = table(spark, folder, "events")
    b = x_bounds(df, "ts", df.schema["ts"].dataType, ["user_id"])
    return b.select("user_id", F.timestamp_micros("lo").cast("timestamp_ntz").alias("lo"), F.timestamp_micros("hi").cast("timestamp_ntz").alias("hi"), "rows")


def _bounds_scaled(spark, folder):
    """Bounds of a converted x with a negative scale: the ends swap."""
    df = table(spark, folder, "orders")
    job = Job.from_dict({"x": "o_totalprice", "y": ["o_orderkey"], "scaling": {"o_totalprice": {"scale": -0.5, "offset": 7}}})
    return rounded(prepare(df, job, ["o_orderstatus"], ["o_orderkey"], need_bounds=True).bounds)


def _distinct(spark, folder):
    from seriesmill.operators.bounds import distinct_x
    from seriesmill.plans.process import keep_ranges

    job = Job.from_dict({"x": "l_shipdate", "y": ["l_tax"], "ranges": [["1996-01-01", "1997-12-31"], ["2000-06-01", None]]})
    prepared = prepare(numbered(spark, folder, "lineitem"), job, ["l_returnflag"])
    return distinct_x(keep_ranges(prepared), "l_shipdate", ["l_returnflag"])


def _zoned(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def _zoned_day(spark, folder):
    run = job_query("events", {**EVENTS, **interval("1d", ["mean", "count"])}, derive=_zoned, zone="Europe/Berlin")
    return run(spark, folder).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _duration(df):
    start = F.expr("TIMESTAMP_NTZ'2024-01-01 00:00:00'")
    return df.withColumn("gap", (F.col("ts") - start))


def _with_gaps(df):
    """Every seventh value is missing, and all of user 3."""
    return df.withColumn("value", F.when((F.col("event_id") % 7 != 0) & (F.col("user_id") != 3), F.col("value")))


QUERIES = {
    "x_bounds": (_bounds, "SELECT user_id, min(ts) AS lo, max(ts) AS hi, count(*) AS rows FROM events GROUP BY user_id"),
    "x_bounds_scaled": (
        _bounds_scaled,
        """SELECT o_orderstatus, round(min(o_totalprice * -0.5 + 7), 9) AS lo, round(max(o_totalprice * -0.5 + 7), 9) AS hi,
           count(*) AS rows FROM orders GROUP BY 1""",
    ),
    "distinct_x": (
        _distinct,
        """SELECT l_returnflag, count(DISTINCT l_shipdate) AS distinct_x FROM lineitem
           WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' OR l_shipdate >= TIMESTAMP '2000-06-01'
           GROUP BY 1""",
    ),
    "interval_6h": (
        job_query("events", {**EVENTS, **interval("6h", ["mean", "max", "count"])}),
        """SELECT time_bucket(INTERVAL '6 hours', ts) AS ts, round(avg(value), 9) AS value_mean, max(value) AS value_max,
           count(value) AS value_count FROM events GROUP BY 1""",
    ),
    "interval_week": (
        job_query("lineitem", {"x": "l_shipdate", "y": ["l_quantity"], **interval("1w", ["sum", "count"])}, tie=("pos",)),
        """SELECT date_trunc('week', l_shipdate)::TIMESTAMP AS l_shipdate, round(sum(l_quantity), 9) AS l_quantity_sum,
           count(l_quantity) AS l_quantity_count FROM lineitem GROUP BY 1""",
    ),
    "interval_month": (
        job_query("orders", {"x": "o_orderdate", "y": ["o_totalprice"], **interval("1mo", ["mean", "min", "max"])}, tie=("o_orderkey",), digits=6),
        """SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, round(avg(o_totalprice), 6) AS o_totalprice_mean,
           min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max FROM orders GROUP BY 1""",
    ),
    "interval_quarters": (
        job_query("orders", {"x": "o_orderdate", "y": ["o_totalprice"], **interval("2q", ["count"])}, tie=("o_orderkey",)),
        """SELECT make_timestamp(year(o_orderdate), CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 7 END, 1, 0, 0, 0.0) AS o_orderdate,
           count(o_totalprice) AS o_totalprice FROM orders GROUP BY 1""",
    ),
    "interval_seconds": (
        job_query("events", {**EVENTS, **interval(90, ["min", "sum"])}),
        """SELECT make_timestamp((epoch_us(ts) // 90000000) * 90000000) AS ts, min(value) AS value_min,
           round(sum(value), 9) AS value_sum FROM events GROUP BY 1""",
    ),
    "interval_day_zoned": (
        _zoned_day,
        """SELECT ((date_trunc('day', (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Berlin')::TIMESTAMP AT TIME ZONE 'Europe/Berlin')
           AT TIME ZONE 'UTC') AS ts, round(avg(value), 9) AS value_mean, count(value) AS value_count FROM events GROUP BY 1""",
    ),
    "interval_int": (
        job_query("customer", {"x": "c_custkey", "y": ["c_acctbal"], **interval(64, ["mean", "count"])}, tie=("c_custkey",)),
        """SELECT (c_custkey // 64) * 64 AS c_custkey, round(avg(c_acctbal), 9) AS c_acctbal_mean, count(c_acctbal) AS c_acctbal_count
           FROM customer GROUP BY 1""",
    ),
    "interval_float": (
        job_query("customer", {"x": "c_acctbal", "y": ["c_custkey"], **interval(750.5, ["count", "min", "max"])}, tie=("c_custkey",)),
        """SELECT round(floor(c_acctbal / 750.5::DOUBLE) * 750.5::DOUBLE, 9) AS c_acctbal, count(c_custkey) AS c_custkey_count,
           min(c_custkey) AS c_custkey_min, max(c_custkey) AS c_custkey_max FROM customer GROUP BY 1""",
    ),
    "interval_duration": (
        job_query("events", {"x": "gap", "y": ["value"], **interval("12h", ["mean", "count"])}, derive=_duration),
        """SELECT floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6 / 43200.0::DOUBLE) * 43200.0::DOUBLE AS gap,
           round(avg(value), 9) AS value_mean, count(value) AS value_count FROM events GROUP BY 1""",
    ),
    "date_x_interval": (
        job_query(
            "orders", {"x": "day", "y": ["o_totalprice"], **interval("1d", ["sum", "count"])}, tie=("o_orderkey",), digits=4,
            derive=lambda df: df.withColumn("day", F.col("o_orderdate").cast("date")),
        ),
        """SELECT o_orderdate::DATE::TIMESTAMP AS day, round(sum(o_totalprice), 4) AS o_totalprice_sum, count(o_totalprice) AS o_totalprice_count
           FROM orders GROUP BY 1""",
    ),
    "row_index_interval": (
        job_query("lineitem", {"x": "__row_index__", "y": ["l_extendedprice"], **interval(1000, ["mean", "max"])}, tie=("pos",), digits=6),
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, l_extendedprice AS v FROM lineitem)
           SELECT (i // 1000) * 1000 AS __row_index__, round(avg(v), 6) AS l_extendedprice_mean, max(v) AS l_extendedprice_max FROM n GROUP BY 1""",
    ),
    "points_time": (
        job_query("events", {**EVENTS, **points(200, ["mean", "count"])}),
        """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
           w AS (SELECT lo, greatest(1, ceil((hi - lo + 1) / 200))::BIGINT AS w FROM b)
           SELECT make_timestamp(((epoch_us(ts) - lo) // w) * w + lo) AS ts, round(avg(value), 9) AS value_mean, count(value) AS value_count
           FROM events, w GROUP BY 1""",
    ),
    "points_in_range": (
        job_query("events", {**EVENTS, "ranges": [["2024-01-05", "2024-01-09T12:00"], ["2024-01-20", None]], **points(75, ["min", "max"])}),
        """WITH b AS (SELECT epoch_us(greatest(min(ts), TIMESTAMP '2024-01-05')) AS lo, epoch_us(max(ts)) AS hi FROM events),
           w AS (SELECT lo, greatest(1, ceil((hi - lo + 1) / 75))::BIGINT AS w FROM b)
           SELECT make_timestamp(((epoch_us(ts) - lo) // w) * w + lo) AS ts, min(value) AS value_min, max(value) AS value_max
           FROM events, w WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-09 12:00:00' OR ts >= TIMESTAMP '2024-01-20' GROUP BY 1""",
    ),
    "points_per_user": (
        job_query("events", {**EVENTS, **points(10, ["mean", "count"])}, by=("user_id",)),
        """WITH b AS (SELECT user_id, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY 1),
           w AS (SELECT user_id, lo, greatest(1, ceil((hi - lo + 1) / 10))::BIGINT AS w FROM b)
           SELECT e.user_id, make_timestamp(((epoch_us(ts) - lo) // w) * w + lo) AS ts, round(avg(value), 9) AS value_mean, count(value) AS value_count
           FROM events e JOIN w ON e.user_id = w.user_id GROUP BY 1, 2""",
    ),
    "points_int": (
        job_query("part", {"x": "p_size", "y": ["p_retailprice"], **points(7, ["mean", "count"])}, tie=("p_partkey",)),
        """WITH b AS (SELECT min(p_size)::BIGINT AS lo, max(p_size)::BIGINT AS hi FROM part),
           w AS (SELECT lo, greatest(1, ceil((hi - lo + 1) / 7))::BIGINT AS w FROM b)
           SELECT ((p_size - lo) // w) * w + lo AS p_size, round(avg(p_retailprice), 9) AS p_retailprice_mean,
           count(p_retailprice) AS p_retailprice_count FROM part, w GROUP BY 1""",
    ),
    "points_float": (
        job_query("orders", {"x": "o_totalprice", "y": ["o_orderkey"], **points(40, ["count", "max"])}, tie=("o_orderkey",), digits=6),
        """WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
           w AS (SELECT lo, CASE WHEN hi = lo THEN 1.0::DOUBLE ELSE (hi - lo) / 40.0::DOUBLE END AS w FROM b)
           SELECT round(least(greatest(floor((o_totalprice - lo) / w), 0), 39) * w + lo, 6) AS o_totalprice, count(o_orderkey) AS o_orderkey_count,
           max(o_orderkey) AS o_orderkey_max FROM orders, w GROUP BY 1""",
    ),
    "per_value_text": (
        job_query("events", {"x": "event_type", "y": ["value"], "aggregation": {"method": "per_value", "functions": ["mean", "median", "count"]}}),
        """SELECT event_type, round(avg(value), 9) AS value_mean, round(median(value), 9) AS value_median, count(value) AS value_count FROM events GROUP BY 1""",
    ),
    "per_value_number": (
        job_query("lineitem", {"x": "l_quantity", "y": ["l_discount"], "aggregation": {"method": "group", "functions": ["mean", "std"]}}, tie=("pos",)),
        """SELECT l_quantity, round(avg(l_discount), 9) AS l_discount_mean, round(stddev_samp(l_discount), 9) AS l_discount_std FROM lineitem GROUP BY 1""",
    ),
    "agg_all_functions": (
        job_query("events", {**EVENTS, **interval("1d", ALL)}),
        f"SELECT date_trunc('day', ts)::TIMESTAMP AS ts, {ALL_SQL} FROM events GROUP BY 1",
    ),
    "agg_all_functions_per_user": (
        job_query("events", {**EVENTS, **interval("1w", ALL)}, by=("user_id",)),
        f"SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS ts, {ALL_SQL} FROM events GROUP BY 1, 2",
    ),
    "median_split": (
        _median_split,
        """SELECT l_returnflag, round(median(l_extendedprice), 6) AS price_median, count(*) AS price_count FROM lineitem GROUP BY 1""",
    ),
    "first_last": (
        job_query("lineitem", {"x": "l_shipdate", "y": ["l_extendedprice", "l_returnflag"], **interval("1mo", ["first", "last"])}, tie=("pos",)),
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM lineitem)
           SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS l_shipdate, first(l_extendedprice ORDER BY l_shipdate, i) AS l_extendedprice_first,
           last(l_extendedprice ORDER BY l_shipdate, i) AS l_extendedprice_last, first(l_returnflag ORDER BY l_shipdate, i) AS l_returnflag_first,
           last(l_returnflag ORDER BY l_shipdate, i) AS l_returnflag_last FROM n GROUP BY 1""",
    ),
    "first_last_null": (
        job_query("events", {**EVENTS, **interval("3h", ["first", "last", "count"])}, derive=_with_gaps),
        """WITH n AS (SELECT ts, event_id, CASE WHEN event_id % 7 <> 0 AND user_id <> 3 THEN value END AS value FROM events)
           SELECT time_bucket(INTERVAL '3 hours', ts) AS ts, first(value ORDER BY ts, event_id) AS value_first,
           last(value ORDER BY ts, event_id) AS value_last, count(value) AS value_count FROM n GROUP BY 1""",
    ),
    "first_last_file_order": (
        job_query("orders", {"x": "o_orderdate", "y": ["o_totalprice"], "sort": False, **interval("1mo", ["first", "last"])}, tie=("pos",)),
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM orders)
           SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS o_orderdate, first(o_totalprice ORDER BY i) AS o_totalprice_first,
           last(o_totalprice ORDER BY i) AS o_totalprice_last FROM n GROUP BY 1""",
    ),
    "sum_all_null": (
        job_query("events", {"x": "user_id", "y": ["value"], "aggregation": {"method": "per_value", "functions": ["sum", "max", "count", "std"]}}, derive=_with_gaps),
        """WITH n AS (SELECT user_id, CASE WHEN event_id % 7 <> 0 AND user_id <> 3 THEN value END AS value FROM events)
           SELECT user_id, round(coalesce(sum(value), 0), 9) AS value_sum, max(value) AS value_max, count(value) AS value_count,
           round(stddev_samp(value), 9) AS value_std FROM n GROUP BY 1""",
    ),
    "nan_values": (
        job_query("events", {**EVENTS, **interval("12h", ["min", "max"])}, derive=lambda df: df.withColumn("value", F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value")))),
        """SELECT time_bucket(INTERVAL '12 hours', ts) AS ts, min(value) FILTER (event_id % 5 <> 0) AS value_min,
           max(value) FILTER (event_id % 5 <> 0) AS value_max FROM events GROUP BY 1""",
    ),
    "text_functions": (
        job_query("events", {"x": "ts", "y": ["event_type", "value"], **interval("1d", ["mean", "first", "last", "count", "min", "max"])}),
        """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, first(event_type ORDER BY ts, event_id) AS event_type_first,
           last(event_type ORDER BY ts, event_id) AS event_type_last, count(event_type) AS event_type_count, min(event_type) AS event_type_min,
           max(event_type) AS event_type_max, round(avg(value), 9) AS value_mean, first(value ORDER BY ts, event_id) AS value_first,
           last(value ORDER BY ts, event_id) AS value_last, count(value) AS value_count, min(value) AS value_min, max(value) AS value_max
           FROM events GROUP BY 1""",
    ),
    "text_fallback_first": (
        job_query("events", {"x": "ts", "y": ["event_type"], **interval("8h", ["mean"])}),
        """SELECT time_bucket(INTERVAL '8 hours', ts) AS ts, first(event_type ORDER BY ts, event_id) AS event_type FROM events GROUP BY 1""",
    ),
    "bool_mean": (
        job_query("events", {"x": "ts", "y": ["high"], **interval("1d", ["mean", "sum", "max", "count"])}, derive=lambda df: df.withColumn("high", F.col("value") > 50)),
        """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, round(avg((value > 50)::INT), 9) AS high_mean, sum((value > 50)::INT)::BIGINT AS high_sum,
           max((value > 50)::INT) AS high_max, count(value) AS high_count FROM events GROUP BY 1""",
    ),
    "estimate_rows": (
        _estimates,
        """WITH b AS (SELECT count(*) AS n, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events),
           c AS (SELECT *, least(1.0::DOUBLE, (least(hi, lo + 259200000000) - lo + greatest(0, least(hi, lo + 518400000000) - (lo + 432000000000)))::DOUBLE / (hi - lo)) AS f FROM b)
           SELECT 'none' AS method, floor(n * f)::BIGINT AS estimate FROM c
           UNION ALL SELECT 'every_nth', ceil(n * f / 7)::BIGINT FROM c
           UNION ALL SELECT 'interval', floor(least(n * f, floor((hi - lo) / 1e6::DOUBLE * f / 21600) + 1 + 2))::BIGINT FROM c
           UNION ALL SELECT 'target_points', floor(least(n * f, 50 * 2))::BIGINT FROM c
           UNION ALL SELECT 'per_value', count(DISTINCT ts) FROM events, b
             WHERE epoch_us(ts) BETWEEN lo AND lo + 259200000000 OR epoch_us(ts) BETWEEN lo + 432000000000 AND lo + 518400000000""",
    ),
}
