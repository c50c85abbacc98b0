"""Row-wise work: projection, scaling, order and row selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill import Job, process
from seriesmill.functions.durations import seconds_to_clock, seconds_to_compact, text_to_seconds
from seriesmill.functions.times import from_us, iso_text_to_us
from seriesmill.operators.order import number_table
from seriesmill.plans.export import preview
from seriesmill.plans.plot import table_rows
from seriesmill.plans.process import prepare, run

from .base import job_query, numbered, rounded, table

EVENTS = {"x": "ts", "y": ["value"]}


def _seconds_text(spark, folder):
    """Span texts of each user's events."""
    df = table(spark, folder, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.max("value").alias("v"))
    span = (F.unix_micros(F.col("b").cast("timestamp")) - F.unix_micros(F.col("a").cast("timestamp"))) / F.lit(1e6)
    short = F.round(F.col("v") % 60, 2)
    return df.select(
        "user_id", seconds_to_clock(span).alias("clock"), seconds_to_compact(-span).alias("compact"),
        seconds_to_clock(short).alias("short"), seconds_to_compact(F.lit(0.0)).alias("zero"),
    )


CLOCK_SQL = """
    WITH s AS (SELECT user_id, epoch_us(max(ts)) - epoch_us(min(ts)) AS us, round(max(value) % 60, 2) AS v FROM events GROUP BY 1),
    p AS (SELECT *, us // 86400000000 AS d, (us // 3600000000) % 24 AS h, (us // 60000000) % 60 AS m, us % 60000000 AS r,
          (us // 1000000) % 60 AS s, (us // 1000) % 1000 AS ms, us % 1000 AS u FROM s)
    SELECT user_id,
      CASE WHEN d > 0 THEN d || 'd ' ELSE '' END || printf('%02d:%02d:', h, m) ||
        regexp_replace(regexp_replace(printf('%06.3f', r / 1e6::DOUBLE), '0+$', ''), '\\.$', '') AS clock,
      '-' || concat(CASE WHEN d > 0 THEN d || 'd' END, CASE WHEN h > 0 THEN h || 'h' END, CASE WHEN m > 0 THEN m || 'm' END,
        CASE WHEN s > 0 THEN s || 's' END, CASE WHEN ms > 0 THEN ms || 'ms' END, CASE WHEN u > 0 THEN u || 'us' END) AS compact,
      printf('%g', v) || ' s' AS short, '0s' AS zero
    FROM p
"""


def _duration_texts(spark, folder):
    """Duration texts built from part sizes and read back as seconds."""
    size = F.col("p_size").cast("string")
    text = (
        F.when(F.col("p_partkey") % 5 == 0, F.concat(size, F.lit("h"), size, F.lit(".5m")))
        .when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("-"), size, F.lit("ms")))
        .when(F.col("p_partkey") % 5 == 2, F.concat(size, F.lit("w2d")))
        .when(F.col("p_partkey") % 5 == 3, size)
        .otherwise(F.concat(size, F.lit(" minutes")))
    )
    return table(spark, folder, "part").select("p_partkey", F.round(text_to_seconds(text), 6).alias("seconds"))


def _iso_texts(spark, folder):
    """Times written in the accepted ISO forms and read back."""
    ts, kind = F.col("ts"), F.col("event_id") % 8
    text = (
        F.when(kind == 0, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
        .when(kind == 1, F.date_format(ts, "yyyy-MM-dd HH:mm"))
        .when(kind == 2, F.date_format(ts, "yyyy-MM-dd"))
        .when(kind == 3, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("789Z")))
        .when(kind == 4, F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+0130")))
        .when(kind == 5, F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit("-05:30")))
        .when(kind == 6, F.floor(F.unix_micros(ts.cast("timestamp")) / 1000000).cast("string"))
        .otherwise(F.concat(F.lit("at "), F.date_format(ts, "yyyy-MM-dd")))
    )
    return table(spark, folder, "events").select("event_id", from_us(iso_text_to_us(text)).alias("moment"))


def _preview(spark, folder):
    job = Job.from_dict({"x": "l_shipdate", "y": ["l_extendedprice", "l_returnflag"], "csv": {"separator": ";", "float_precision": 1}})
    return preview(numbered(spark, folder, "lineitem"), job, rows=20)


def _window(spark, folder):
    """The first 500 rows of a view, with their original types."""
    lo = 1704412800.0  # 2024-01-05
    job = Job.from_dict({"x": "ts", "y": ["event_type", "value"], "ranges": [["2024-01-20", None]]})
    return table_rows(table(spark, folder, "events"), job, ["event_id"], limit=500, view=(lo, lo + 86_400 * 5)).rows


def _category_order(spark, folder):
    """Priorities numbered in the order in which they first appear in the file."""
    df = numbered(spark, folder, "orders").groupBy("o_orderpriority").agg(F.min("pos").alias("first_pos"))
    return number_table(df, ["first_pos"], "place")


def _sorted(spark, folder):
    job = Job.from_dict({"x": "l_shipdate", "y": ["l_orderkey", "l_quantity"]})
    return run(prepare(numbered(spark, folder, "lineitem"), job)).sorted()


def _default_axes(spark, folder):
    """A job that names no columns takes time as x and the first two plain ones as y."""
    return process(table(spark, folder, "events"), Job(), tie=["event_id"])


QUERIES = {
    "default_axes": (_default_axes, "SELECT ts, user_id, value FROM events"),
    "raw_select": (
        job_query("lineitem", {"x": "l_extendedprice", "y": ["l_quantity", "l_returnflag", "l_quantity", "l_extendedprice"]}, tie=("pos",)),
        "SELECT l_extendedprice, l_quantity, l_returnflag FROM lineitem",
    ),
    "sorted_raw": (_sorted, "SELECT l_shipdate, l_orderkey, l_quantity FROM lineitem ORDER BY l_shipdate"),
    "duration_seconds": (
        job_query("events", {"x": "ts", "y": ["gap"], "aggregation": {"method": "interval", "every": "1d", "functions": ["min", "max"]}}, digits=6,
                  derive=lambda df: df.withColumn("gap", F.col("ts") - F.expr("TIMESTAMP_NTZ'2024-01-10 12:00:00'"))),
        """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, round((epoch_us(min(ts)) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 1e6::DOUBLE, 6) AS gap_min,
           round((epoch_us(max(ts)) - epoch_us(TIMESTAMP '2024-01-10 12:00:00')) / 1e6::DOUBLE, 6) AS gap_max FROM events GROUP BY 1""",
    ),
    "decimal_to_double": (
        job_query("orders", {"x": "o_totalprice", "y": ["o_totalprice_d"], "aggregation": {"method": "interval", "every": 25000, "functions": ["max", "count"]}}, tie=("o_orderkey",),
                  derive=lambda df: df.withColumns({"o_totalprice_d": F.col("o_totalprice").cast("decimal(15,2)"), "o_totalprice": F.col("o_totalprice").cast("decimal(15,2)")})),
        """SELECT floor(o_totalprice / 25000::DOUBLE) * 25000::DOUBLE AS o_totalprice, max(o_totalprice) AS o_totalprice_d_max, count(*) AS o_totalprice_d_count
           FROM orders GROUP BY 1""",
    ),
    "scale_y": (
        job_query("customer", {"x": "c_custkey", "y": ["c_acctbal", "c_nationkey", "c_mktsegment"], "scaling": {"c_acctbal": {"scale": 1.8, "offset": 32}, "c_nationkey": {"scale": 0.5}, "unused": {"scale": 3}}}, tie=("c_custkey",)),
        "SELECT c_custkey, round(c_acctbal * 1.8::DOUBLE + 32, 9) AS c_acctbal, c_nationkey * 0.5::DOUBLE AS c_nationkey, c_mktsegment FROM customer",
    ),
    "scale_then_aggregate": (
        job_query("events", {**EVENTS, "scaling": {"value": {"scale": -2, "offset": 1}}, "aggregation": {"method": "interval", "every": "1d", "functions": ["sum", "max"]}}),
        """SELECT date_trunc('day', ts)::TIMESTAMP AS ts, round(sum(value * -2 + 1), 9) AS value_sum, round(max(value * -2 + 1), 9) AS value_max FROM events GROUP BY 1""",
    ),
    "shift_time": (
        job_query("events", {**EVENTS, "scaling": {"ts": {"offset": "-2h30m"}}}),
        "SELECT ts - INTERVAL '150 minutes' AS ts, value FROM events",
    ),
    "drop_bad_x": (
        job_query("lineitem", {"x": "x", "y": ["l_tax"], "aggregation": {"method": "per_value", "functions": ["count", "sum"]}}, tie=("pos",),
                  derive=lambda df: df.withColumn("x", F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_linenumber") == 2, float("nan")).otherwise(F.col("l_quantity")))),
        """SELECT l_quantity AS x, count(l_tax) AS l_tax_count, round(sum(l_tax), 9) AS l_tax_sum FROM lineitem WHERE l_linenumber > 2 GROUP BY 1""",
    ),
    "every_nth": (
        job_query("lineitem", {"x": "l_shipdate", "y": ["l_extendedprice", "l_quantity"], "ranges": [["1996-01-01", "1996-12-31"], ["1999-01-01", None]], "aggregation": {"method": "every_nth", "n": 7}}, tie=("pos",)),
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM lineitem),
           r AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, i) - 1 AS rn FROM n
                 WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' OR l_shipdate >= TIMESTAMP '1999-01-01')
           SELECT l_shipdate, l_extendedprice, l_quantity FROM r WHERE rn % 7 = 0""",
    ),
    "every_nth_per_user": (
        job_query("events", {**EVENTS, "aggregation": {"method": "nth", "n": 10}}, by=("user_id",)),
        """WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn FROM events)
           SELECT user_id, ts, value FROM r WHERE rn % 10 = 0""",
    ),
    "row_index_range": (
        job_query("lineitem", {"x": "__row_index__", "y": ["l_orderkey"], "ranges": [[100, 1999], [5000, 5999.5]]}, tie=("pos",)),
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, l_orderkey FROM lineitem)
           SELECT i AS __row_index__, l_orderkey FROM n WHERE i BETWEEN 100 AND 1999 OR i BETWEEN 5000 AND 5999""",
    ),
    "preview_head": (
        _preview,
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM lineitem),
           r AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, i) AS line_no FROM n),
           l AS (SELECT line_no, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S.%f') || ';' || printf('%.1f', l_extendedprice) || ';' || l_returnflag AS line FROM r WHERE line_no <= 20)
           SELECT 0::BIGINT AS line_no, 'l_shipdate;l_extendedprice;l_returnflag' AS line UNION ALL SELECT line_no, line FROM l""",
    ),
    "table_window": (
        _window,
        """SELECT ts, event_type, value FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-10' ORDER BY ts, event_id LIMIT 500""",
    ),
    "category_order": (
        _category_order,
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM orders), f AS (SELECT o_orderpriority, min(i) AS first_pos FROM n GROUP BY 1)
           SELECT o_orderpriority, first_pos, row_number() OVER (ORDER BY first_pos) - 1 AS place FROM f""",
    ),
    "iso_text_to_time": (
        _iso_texts,
        """SELECT event_id, CASE event_id % 8 WHEN 0 THEN ts WHEN 1 THEN date_trunc('minute', ts)::TIMESTAMP WHEN 2 THEN date_trunc('day', ts)::TIMESTAMP
           WHEN 3 THEN ts WHEN 4 THEN date_trunc('second', ts)::TIMESTAMP - INTERVAL '90 minutes' WHEN 5 THEN date_trunc('second', ts)::TIMESTAMP + INTERVAL '330 minutes'
           WHEN 6 THEN date_trunc('second', ts)::TIMESTAMP END AS moment FROM events""",
    ),
    "duration_text_to_seconds": (
        _duration_texts,
        """SELECT p_partkey, round(CASE p_partkey % 5 WHEN 0 THEN p_size * 3600 + (p_size + 0.5::DOUBLE) * 60 WHEN 1 THEN p_size / -1000.0::DOUBLE
           WHEN 2 THEN p_size * 604800 + 172800 WHEN 3 THEN p_size END, 6) AS seconds FROM part""",
    ),
    "seconds_to_text": (_seconds_text, CLOCK_SQL),
}
