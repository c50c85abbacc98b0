"""Reductions for display and look-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill import Job
from seriesmill.functions.times import to_us
from seriesmill.functions.cells import readout_text
from seriesmill.operators import display as D
from seriesmill.operators.lookup import lookup_hold, lookup_nearest
from seriesmill.plans.plot import plot_points

from .base import numbered, rounded, table

EVENTS = {"x": "ts", "y": ["value"]}

# The two extremes of every bucket; {key} are the grouping columns, {src} gives bucket b, x and v.
ENVELOPE_SQL = """
    , g AS (SELECT {key} b, min(v) AS ylo, max(v) AS yhi, arg_min(x, (v, x)) AS xlo, arg_min(x, (-v, x)) AS xhi FROM src GROUP BY ALL)
    SELECT {key} 'value' AS series, xlo AS x, ylo AS y FROM g UNION ALL SELECT {key} 'value', xhi, yhi FROM g
"""


def _plot(name, job, tie, by=(), **options):
    def run(spark, folder):
        df = numbered(spark, folder, name) if "pos" in tie else table(spark, folder, name)
        return plot_points(df, Job.from_dict(job), by, tie, **options).points

    return run


def _codes(spark, folder):
    """Events with their type as a code of the sorted dictionary; type 'view' of user 7 is missing."""
    df = table(spark, folder, "events").withColumn("event_type", F.when((F.col("event_type") != "view") | (F.col("user_id") != 7), F.col("event_type")))
    return D.encode(df.select("event_id", "event_type"), "event_type", D.text_dictionary(df, ["event_type"]))


def _category_codes(spark, folder):
    df = numbered(spark, folder, "lineitem")
    return D.category_dictionary(df, "l_linestatus", F.col("pos"), ["l_returnflag"])


def _splice(spark, folder):
    """A coarse overview with the days 10 to 12 in full detail; counts have no detail."""
    df = table(spark, folder, "events")
    hour = {"aggregation": {"method": "interval", "every": "12h", "functions": ["max", "count"]}}
    overview = plot_points(df, Job.from_dict({**EVENTS, **hour}), tie=["event_id"]).points
    lo = 1704844800.0
    detail = plot_points(df, Job.from_dict(EVENTS), tie=["event_id"], view=(lo, lo + 172800)).points
    detail = detail.withColumn("series", F.lit("value_max"))
    return D.splice(overview, detail, lo, lo + 172800)


def _recode(spark, folder):
    """Codes of one user group's dictionary moved to the dictionary of the others."""
    df = table(spark, folder, "events").select("event_id", "event_type")
    large = df.filter("event_type > 'purchase'")
    old, new = D.text_dictionary(df, ["event_type"]), D.text_dictionary(large, ["event_type"])
    return D.recode(D.encode(df, "event_type", old).withColumnRenamed("event_type", "y"), old, new)


def _states(spark, folder):
    return D.state_intervals(table(spark, folder, "events"), ["user_id"], "ts", ["event_id"], "event_type")


def _probes(spark, folder):
    orders = table(spark, folder, "orders")
    moment = F.expr("TIMESTAMP_NTZ'2023-12-31 00:00:00'") + F.make_dt_interval(days=F.lit(0), hours=F.lit(0), mins=F.lit(0), secs=(F.col("o_totalprice") * 6).cast("decimal(18,6)"))
    return orders.select((F.col("o_custkey") % 150).alias("user_id"), moment.alias("ts"), F.col("o_orderkey").alias("probe"))


def _nearest(spark, folder):
    """The event nearest to each probe time, per user."""
    return lookup_nearest(table(spark, folder, "events"), _probes(spark, folder), ["user_id"], "ts", "event_id", "value", "probe", to_us)


def _asof(spark, folder):
    """The type each user was last in at every probe time."""
    return lookup_hold(table(spark, folder, "events"), _probes(spark, folder), ["user_id"], "ts", "event_id", "event_type", "probe")


PROBES_SQL = """WITH p AS (SELECT o_custkey % 150 AS user_id, TIMESTAMP '2023-12-31' + to_microseconds(round(o_totalprice * 6 * 1000000)::BIGINT) AS ts, o_orderkey AS probe FROM orders)"""


def _priority_points(spark, folder):
    job = Job.from_dict({"x": "o_orderpriority", "y": ["o_totalprice"]})
    return plot_points(numbered(spark, folder, "orders"), job).points


def _summary(spark, folder):
    return D.category_summary(_priority_points(spark, folder))


def _summary_texts(spark, folder):
    """Statuses and prices per customer segment bucket, told as a plot tells them."""
    df = numbered(spark, folder, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    plot = plot_points(df, Job.from_dict({"x": "day", "y": ["o_orderstatus", "o_totalprice"]}))
    days = plot.x_categories.select(F.col("code").cast("double").alias("x"), F.col("value").alias("day"))
    return D.category_summary(plot.points, texts=plot.categories).join(days, "x").select("series", "day", "text")


def _splice_texts(spark, folder):
    """Types of a month in detail, whose dictionary lacks some, inside those of the whole time."""
    events = table(spark, folder, "events")
    job = Job.from_dict({"x": "ts", "y": ["event_type"]})
    whole = plot_points(events, job, tie=["event_id"])
    lo, hi = 1_705_276_800.0, 1_706_745_600.0
    part = plot_points(events.filter("event_type <> 'click'"), job, tie=["event_id"], view=(lo, hi))
    return D.splice(whole.points, part.points, lo, hi, codes={"event_type": (part.categories["event_type"], whole.categories["event_type"])})


def _readout(spark, folder):
    """Numbers of very different sizes as a plot shows them."""
    power, price = F.pmod("l_orderkey", F.lit(17)) - 9, F.col("l_extendedprice") * F.when(F.col("l_linenumber") == 1, -1).otherwise(1)
    value = F.when(power < 0, price / F.pow(F.lit(10.0), -power)).otherwise(price * F.pow(F.lit(10.0), power))
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", value.alias("value"))
    return rows.select("l_orderkey", "l_linenumber", readout_text(F.col("value")).alias("shown"))


def _unique(spark, folder):
    """Raw orders have many rows per priority; one mean per priority has one."""
    means = Job.from_dict({"x": "o_orderpriority", "y": ["o_totalprice"], "aggregation": {"method": "per_value", "functions": ["mean", "count"]}})
    both = D.category_unique(_priority_points(spark, folder)).unionByName(D.category_unique(plot_points(numbered(spark, folder, "orders"), means).points))
    return both


PLACES_SQL = """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM orders),
    f AS (SELECT o_orderpriority AS c, min(i) AS a FROM n GROUP BY 1), k AS (SELECT c, (row_number() OVER (ORDER BY a) - 1)::DOUBLE AS x FROM f)"""

QUERIES = {
    "plot_frame": (
        _plot("events", {"x": "ts", "y": ["value", "event_id"]}, ("event_id",)),
        """SELECT 'value' AS series, epoch_us(ts) / 1e6::DOUBLE AS x, value AS y FROM events
           UNION ALL SELECT 'event_id', epoch_us(ts) / 1e6::DOUBLE, event_id::DOUBLE FROM events""",
    ),
    "envelope": (
        _plot("events", EVENTS, ("event_id",), buckets=400),
        """WITH b AS (SELECT epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events), w AS (SELECT lo, greatest(1, ceil((hi - lo + 1) / 400))::BIGINT AS w FROM b),
           src AS (SELECT (epoch_us(ts) - lo) // w AS b, epoch_us(ts) / 1e6::DOUBLE AS x, value AS v FROM events, w)""" + ENVELOPE_SQL.format(key=""),
    ),
    "envelope_points": (
        _plot("lineitem", {"x": "l_extendedprice", "y": ["value"]} | {"y": ["l_quantity"]}, ("pos",), buckets=250),
        """WITH b AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem), w AS (SELECT lo, (hi - lo) / 250.0::DOUBLE AS w FROM b),
           src AS (SELECT least(greatest(floor((l_extendedprice - lo) / w), 0), 249) AS b, l_extendedprice AS x, l_quantity AS v FROM lineitem, w)"""
        + ENVELOPE_SQL.format(key="").replace("'value'", "'l_quantity'"),
    ),
    "envelope_per_user": (
        _plot("events", EVENTS, ("event_id",), ("user_id",), buckets=12),
        """WITH b AS (SELECT user_id, epoch_us(min(ts)) AS lo, epoch_us(max(ts)) AS hi FROM events GROUP BY 1),
           w AS (SELECT user_id, lo, greatest(1, ceil((hi - lo + 1) / 12))::BIGINT AS w FROM b),
           src AS (SELECT e.user_id, (epoch_us(ts) - lo) // w AS b, epoch_us(ts) / 1e6::DOUBLE AS x, value AS v FROM events e JOIN w ON e.user_id = w.user_id)"""
        + ENVELOPE_SQL.format(key="user_id,"),
    ),
    "text_codes": (
        _codes,
        """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' OR user_id <> 7 THEN event_type END AS t FROM events),
           k AS (SELECT t, (row_number() OVER (ORDER BY t) - 1)::DOUBLE AS c FROM (SELECT DISTINCT t FROM e WHERE t IS NOT NULL))
           SELECT event_id, c AS event_type FROM e LEFT JOIN k ON e.t = k.t""",
    ),
    "text_plot": (
        _plot("events", {"x": "ts", "y": ["event_type"], "aggregation": {"method": "interval", "every": "2h", "functions": ["last", "count"]}}, ("event_id",)),
        """WITH g AS (SELECT time_bucket(INTERVAL '2 hours', ts) AS t, last(event_type ORDER BY ts, event_id) AS l, count(event_type) AS n FROM events GROUP BY 1),
           k AS (SELECT l, (row_number() OVER (ORDER BY l) - 1)::DOUBLE AS c FROM (SELECT DISTINCT l FROM g))
           SELECT 'event_type_last' AS series, epoch_us(t) / 1e6::DOUBLE AS x, c AS y FROM g JOIN k ON g.l = k.l
           UNION ALL SELECT 'event_type_count', epoch_us(t) / 1e6::DOUBLE, n::DOUBLE FROM g""",
    ),
    "category_codes": (
        _category_codes,
        """WITH n AS (SELECT row_number() OVER () - 1 AS i, * FROM lineitem), f AS (SELECT l_returnflag, l_linestatus AS value, min(i) AS a FROM n GROUP BY 1, 2)
           SELECT l_returnflag, value, row_number() OVER (PARTITION BY l_returnflag ORDER BY a) - 1 AS code FROM f""",
    ),
    "category_plot": (
        _priority_points,
        PLACES_SQL + " SELECT 'o_totalprice' AS series, x, o_totalprice AS y FROM n JOIN k ON o_orderpriority = c",
    ),
    "category_envelope": (
        _plot("orders", {"x": "o_orderpriority", "y": ["o_totalprice"]}, ("pos",), buckets=1),
        PLACES_SQL + """ SELECT 'o_totalprice' AS series, x, min(o_totalprice) AS y FROM n JOIN k ON o_orderpriority = c GROUP BY x
           UNION ALL SELECT 'o_totalprice', x, max(o_totalprice) FROM n JOIN k ON o_orderpriority = c GROUP BY x""",
    ),
    "detail_splice": (
        _splice,
        """WITH g AS (SELECT epoch_us(time_bucket(INTERVAL '12 hours', ts)) / 1e6::DOUBLE AS x, max(value) AS m, count(value) AS n FROM events GROUP BY 1)
           SELECT 'value_max' AS series, x, m AS y FROM g WHERE x < 1704844800 OR x > 1705017600
           UNION ALL SELECT 'value_count', x, n::DOUBLE FROM g
           UNION ALL SELECT 'value_max', epoch_us(ts) / 1e6::DOUBLE, value FROM events WHERE epoch_us(ts) BETWEEN 1704844800000000 AND 1705017600000000""",
    ),
    "recode_codes": (
        _recode,
        """WITH k AS (SELECT t, (row_number() OVER (ORDER BY t) - 1)::DOUBLE AS c FROM (SELECT DISTINCT event_type AS t FROM events WHERE event_type > 'purchase'))
           SELECT event_id, c AS y FROM events LEFT JOIN k ON event_type = t""",
    ),
    "state_intervals": (
        _states,
        """SELECT user_id, ts AS x_start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x_end, event_type AS value FROM events""",
    ),
    "lookup_nearest": (
        _nearest,
        PROBES_SQL + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id) AS r FROM events) WHERE r = 1),
           l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1),
           b AS (SELECT p.*, l.ts AS t0, l.value AS v0 FROM p ASOF LEFT JOIN l ON p.user_id = l.user_id AND p.ts > l.ts),
           a AS (SELECT b.*, f.ts AS t1, f.value AS v1 FROM b ASOF LEFT JOIN f ON b.user_id = f.user_id AND b.ts <= f.ts)
           SELECT user_id, probe, ts, CASE WHEN t1 IS NOT NULL AND (t0 IS NULL OR epoch_us(t1) - epoch_us(ts) < epoch_us(ts) - epoch_us(t0)) THEN t1 ELSE t0 END AS sample_x,
           CASE WHEN t1 IS NOT NULL AND (t0 IS NULL OR epoch_us(t1) - epoch_us(ts) < epoch_us(ts) - epoch_us(t0)) THEN v1 ELSE v0 END AS value FROM a""",
    ),
    "lookup_asof": (
        _asof,
        PROBES_SQL + """, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS r FROM events) WHERE r = 1)
           SELECT p.user_id, p.probe, p.ts, l.ts AS sample_x, l.event_type AS value FROM p ASOF LEFT JOIN l ON p.user_id = l.user_id AND p.ts >= l.ts""",
    ),
    "category_summary": (
        _summary,
        PLACES_SQL + """ SELECT 'o_totalprice' AS series, x, count(*) AS "values", min(o_totalprice) AS low, max(o_totalprice) AS high,
           CASE WHEN count(*) = 1 THEN printf('%.6g', min(o_totalprice)) ELSE printf('%.6g', min(o_totalprice)) || ' … ' || printf('%.6g', max(o_totalprice)) || ' (' || count(*) || ' values)' END AS text
           FROM n JOIN k ON o_orderpriority = c GROUP BY x""",
    ),
    "category_summary_texts": (
        _summary_texts,
        """SELECT 'o_totalprice' AS series, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN count(*) = 1 THEN printf('%.6g', min(o_totalprice))
           ELSE printf('%.6g', min(o_totalprice)) || ' … ' || printf('%.6g', max(o_totalprice)) || ' (' || count(*) || ' values)' END AS text FROM orders GROUP BY 2
           UNION ALL SELECT 'o_orderstatus', strftime(o_orderdate, '%Y-%m-%d') AS day, CASE WHEN count(*) = 1 THEN min(o_orderstatus) ELSE count(*) || ' values' END FROM orders GROUP BY 2""",
    ),
    "splice_texts": (
        _splice_texts,
        """WITH k AS (SELECT t, (row_number() OVER (ORDER BY t) - 1)::DOUBLE AS c FROM (SELECT DISTINCT event_type AS t FROM events)),
           e AS (SELECT epoch_us(ts) / 1e6::DOUBLE AS x, event_type AS t FROM events)
           SELECT 'event_type' AS series, x, c AS y FROM e JOIN k USING (t) WHERE NOT (x >= 1705276800 AND x <= 1706745600 AND t = 'click')""",
    ),
    "readout_texts": (
        _readout,
        """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey % 17 - 9 AS k, l_extendedprice * CASE WHEN l_linenumber = 1 THEN -1 ELSE 1 END AS p FROM lineitem),
           v AS (SELECT *, CASE WHEN k < 0 THEN p / pow(10.0::DOUBLE, -k) ELSE p * pow(10.0::DOUBLE, k) END AS v FROM p)
           SELECT l_orderkey, l_linenumber, CASE WHEN v <> 0 AND (abs(v) >= 1e7 OR abs(v) < 1e-3) THEN printf('%.4e', v) ELSE printf('%.6g', v) END AS shown FROM v""",
    ),
    "category_unique": (
        _unique,
        """SELECT 'o_totalprice' AS series, count(*) = count(DISTINCT o_orderpriority) AS single FROM orders
           UNION ALL SELECT 'o_totalprice_mean', true UNION ALL SELECT 'o_totalprice_count', true""",
    ),
}
