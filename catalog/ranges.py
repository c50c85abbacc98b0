"""Ranges: filters, splits and measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill import Job
from seriesmill.operators.bounds import x_bounds
from seriesmill.operators.ranges import Interval, covered_share, filter_by_table, resolve, rescaled, span_of, to_relative
from seriesmill.plans.job import Affine, Span
from seriesmill.plans.plot import view_window
from seriesmill.plans.process import prepare, run

from .base import job_query, rounded, table

EVENTS = {"x": "ts", "y": ["value"]}
RANGES = [["2024-01-03T06:00", "2024-01-04"], ["2024-01-03T18:00", "2024-01-06T12:00:00.5"], ["2024-01-25", "2024-01-26"]]
RANGES_SQL = """(ts BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-04' OR ts BETWEEN TIMESTAMP '2024-01-03 18:00:00'
    AND TIMESTAMP '2024-01-06 12:00:00.5' OR ts BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-01-26')"""


def _semi(spark, folder):
    """Orders whose total lies in a band around any customer's balance."""
    bands = table(spark, folder, "customer").select((F.col("c_acctbal") * 40).alias("lo"), (F.col("c_acctbal") * 40 + 25).alias("hi"))
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return filter_by_table(df, "o_totalprice", bands)


def _semi_running(spark, folder):
    """The same in the way used when the ranges table is too large to collect."""
    bands = table(spark, folder, "customer").select((F.col("c_acctbal") * 40).alias("lo"), (F.col("c_acctbal") * 40 + 25).alias("hi"))
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return filter_by_table(df, "o_totalprice", bands, few=0)


def _semi_exact(spark, folder):
    """Whole numbers beyond what doubles hold exactly, by both ways at once."""
    far = 1 << 60
    keys = table(spark, folder, "orders").select((F.col("o_orderkey") + far).alias("k"))
    one = (F.col("p_partkey") * 16 + far).alias("lo"), (F.col("p_partkey") * 16 + far + 1).alias("hi")
    bands = table(spark, folder, "part").select(*one)
    few = filter_by_table(keys, "k", bands.agg(F.min("lo").alias("lo"), F.min("hi").alias("hi")))
    return filter_by_table(keys, "k", bands, few=0).withColumn("way", F.lit("running")).union(few.withColumn("way", F.lit("listed")))


SEMI_EXACT_SQL = """WITH k AS (SELECT o_orderkey + 1152921504606846976 AS k FROM orders), b AS (SELECT p_partkey * 16 + 1152921504606846976 AS lo FROM part)
    SELECT k, 'running' AS way FROM k WHERE EXISTS (SELECT 1 FROM b WHERE k BETWEEN lo AND lo + 1)
    UNION ALL SELECT k, 'listed' FROM k WHERE k BETWEEN (SELECT min(lo) FROM b) AND (SELECT min(lo) + 1 FROM b)"""
SEMI_SQL = """SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM customer
    WHERE o_totalprice BETWEEN c_acctbal * 40 AND c_acctbal * 40 + 25)"""


def _rescale(spark, folder):
    """Price bands, one per part, moved from one scaling of x to another."""
    bands = table(spark, folder, "part").select("p_partkey", F.col("p_retailprice").alias("lo"), (F.col("p_retailprice") + F.col("p_size")).alias("hi"))
    return rounded(rescaled(bands, Affine(2.0, 10.0), Affine(0.25, -3.0)))


def _relative(spark, folder):
    """Each user's busiest stretch as offsets from the start of the data."""
    df = table(spark, folder, "events")
    base = x_bounds(df, "ts", df.schema["ts"].dataType).first().lo / 1e6
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    spans = df.groupBy("user_id").agg(F.min(seconds).alias("lo"), F.max(seconds).alias("hi"))
    start, end = to_relative(F.col("lo"), F.col("hi"), F.lit(base))
    return spans.select("user_id", start.alias("start"), end.alias("end"))


def _measured(spark, folder):
    """Span and covered share of the same relative ranges for every user."""
    df = table(spark, folder, "events")
    dtype = df.schema["ts"].dataType
    bounds = x_bounds(df, "ts", dtype, ["user_id"])
    spans = [Span(0, "2d"), Span("1d", "4d"), Span("20d", None)]
    return bounds, resolve(spans, "relative", dtype, F.col("lo"), None)


def _span(spark, folder):
    bounds, intervals = _measured(spark, folder)
    lo, hi = span_of(intervals[:2], F.col("lo"), F.col("hi"))
    outside = span_of([Interval(0, 1)], F.col("lo"), F.col("hi"))
    return bounds.select("user_id", (lo / F.lit(1e6)).alias("span_lo"), (hi / F.lit(1e6)).alias("span_hi"), outside[0].isNull().alias("disjoint"))


def _covered(spark, folder):
    bounds, intervals = _measured(spark, folder)
    return rounded(bounds.select("user_id", covered_share(intervals, F.col("lo"), F.col("hi")).alias("share")))


def _view(spark, folder):
    df = table(spark, folder, "events")
    window = view_window((1705276800.25, 1705881600.75), df.schema["ts"].dataType)
    return run(prepare(df, Job.from_dict({**EVENTS, "ranges": RANGES}), (), ["event_id"], window=window)).frame


QUERIES = {
    "range_absolute": (
        job_query("events", {**EVENTS, "ranges": [["2024-01-10T06:30", "2024-01-17T00:00:00.25"]]}),
        "SELECT ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 06:30:00' AND TIMESTAMP '2024-01-17 00:00:00.25'",
    ),
    "range_multi": (job_query("events", {**EVENTS, "ranges": RANGES}), f"SELECT ts, value FROM events WHERE {RANGES_SQL}"),
    "range_semi_join": (_semi, SEMI_SQL),
    "range_semi_join_running": (_semi_running, SEMI_SQL),
    "range_table_exact": (_semi_exact, SEMI_EXACT_SQL),
    "range_open_end": (
        job_query("orders", {"x": "o_totalprice", "y": ["o_orderkey"], "ranges": [[None, 20000], [440000.5, None]]}, tie=("o_orderkey",)),
        "SELECT o_totalprice, o_orderkey FROM orders WHERE o_totalprice <= 20000 OR o_totalprice >= 440000.5",
    ),
    "range_relative": (
        job_query("events", {**EVENTS, "range_mode": "relative", "ranges": [[0, "1d12h"], ["20d", None]]}),
        """WITH b AS (SELECT min(ts) AS a FROM events) SELECT ts, value FROM events, b
           WHERE ts BETWEEN a AND a + INTERVAL '36 hours' OR ts >= a + INTERVAL '20 days'""",
    ),
    "range_relative_per_user": (
        job_query("events", {**EVENTS, "range_mode": "relative", "ranges": [["12h", "3d"], ["20d", None]]}, by=("user_id",)),
        """WITH b AS (SELECT user_id, min(ts) AS a FROM events GROUP BY 1) SELECT e.user_id, ts, value FROM events e JOIN b ON e.user_id = b.user_id
           WHERE ts BETWEEN a + INTERVAL '12 hours' AND a + INTERVAL '3 days' OR ts >= a + INTERVAL '20 days'""",
    ),
    "ranges_to_relative": (
        _relative,
        """WITH b AS (SELECT epoch_us(min(ts)) AS a FROM events) SELECT user_id, round((epoch_us(min(ts)) - any_value(a)) / 1e6::DOUBLE, 6) AS start,
           round((epoch_us(max(ts)) - any_value(a)) / 1e6::DOUBLE, 6) AS "end" FROM events, b GROUP BY 1""",
    ),
    "range_scaled_prefilter": (
        job_query("events", {**EVENTS, "scaling": {"ts": {"offset": "1h"}}, "ranges": [["2024-01-05T01:00", "2024-01-08T00:30"]]}),
        """SELECT ts + INTERVAL '1 hour' AS ts, value FROM events
           WHERE ts + INTERVAL '1 hour' BETWEEN TIMESTAMP '2024-01-05 01:00:00' AND TIMESTAMP '2024-01-08 00:30:00'""",
    ),
    "range_scaled_number": (
        job_query("orders", {"x": "o_totalprice", "y": ["o_orderkey"], "scaling": {"o_totalprice": {"scale": -0.1, "offset": 3}}, "ranges": [[-30000, -25000]]}, tie=("o_orderkey",)),
        """SELECT round(o_totalprice * -0.1::DOUBLE + 3, 9) AS o_totalprice, o_orderkey FROM orders
           WHERE o_totalprice * -0.1::DOUBLE + 3 BETWEEN -30000 AND -25000""",
    ),
    "rescale_ranges": (
        _rescale,
        """SELECT p_partkey, round((p_retailprice - 10) / 2 * 0.25 - 3, 9) AS lo, round((p_retailprice + p_size - 10) / 2 * 0.25 - 3, 9) AS hi FROM part""",
    ),
    "range_span": (
        _span,
        """WITH b AS (SELECT user_id, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY 1)
           SELECT user_id, lo / 1e6::DOUBLE AS span_lo, least(hi, lo + 345600000000) / 1e6::DOUBLE AS span_hi, true AS disjoint FROM b""",
    ),
    "covered_fraction": (
        _covered,
        """WITH b AS (SELECT user_id, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY 1)
           SELECT user_id, CASE WHEN hi <= lo THEN 1.0::DOUBLE ELSE round(least(1.0::DOUBLE, (greatest(0, least(hi, lo + 172800000000) - lo)
           + greatest(0, least(hi, lo + 345600000000) - (lo + 86400000000)) + greatest(0, hi - (lo + 1728000000000)))::DOUBLE / (hi - lo)), 9) END AS share FROM b""",
    ),
    "view_window": (
        _view,
        """SELECT ts, value FROM events WHERE epoch_us(ts) BETWEEN 1705276800250000 AND 1705881600750000""",
    ),
    "split_by_range": (
        job_query("events", {**EVENTS, "ranges": [RANGES[0] + ["early"], RANGES[1], RANGES[2] + ["late"]]}, split=True),
        """SELECT 1 AS range_no, 'early' AS range, ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 06:00:00' AND TIMESTAMP '2024-01-04'
           UNION ALL SELECT 2, '2', ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-03 18:00:00' AND TIMESTAMP '2024-01-06 12:00:00.5'
           UNION ALL SELECT 3, 'late', ts, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-25' AND TIMESTAMP '2024-01-26'""",
    ),
    "split_by_range_interval": (
        job_query("events", {**EVENTS, "ranges": RANGES, "aggregation": {"method": "interval", "every": "6h", "functions": ["mean", "count"]}}, split=True),
        """WITH r(range_no, lo, hi) AS (VALUES (1, TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-04'),
             (2, TIMESTAMP '2024-01-03 18:00:00', TIMESTAMP '2024-01-06 12:00:00.5'), (3, TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-26'))
           SELECT range_no, range_no::VARCHAR AS range, time_bucket(INTERVAL '6 hours', ts) AS ts, round(avg(value), 9) AS value_mean, count(value) AS value_count
           FROM events JOIN r ON ts BETWEEN lo AND hi GROUP BY 1, 2, 3""",
    ),
    "split_by_range_points": (
        job_query("events", {**EVENTS, "ranges": RANGES, "aggregation": {"method": "points", "points": 8, "functions": ["min", "max"]}}, split=True),
        """WITH d AS (SELECT min(ts) AS a, max(ts) AS b FROM events), r(range_no, lo, hi) AS (VALUES (1, TIMESTAMP '2024-01-03 06:00:00', TIMESTAMP '2024-01-04'),
             (2, TIMESTAMP '2024-01-03 18:00:00', TIMESTAMP '2024-01-06 12:00:00.5'), (3, TIMESTAMP '2024-01-25', TIMESTAMP '2024-01-26')),
           c AS (SELECT range_no, lo, hi, epoch_us(greatest(lo, a)) AS s, epoch_us(least(hi, b)) AS e FROM r, d),
           w AS (SELECT *, greatest(1, ceil((e - s + 1) / 8))::BIGINT AS w FROM c)
           SELECT range_no, range_no::VARCHAR AS range, make_timestamp(((epoch_us(ts) - s) // w) * w + s) AS ts, min(value) AS value_min, max(value) AS value_max
           FROM events JOIN w ON ts BETWEEN lo AND hi GROUP BY 1, 2, 3""",
    ),
}
