"""Formatting, CSV text and batches over many sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill import Job, process
from seriesmill.functions import cells
from seriesmill.plans import export as X
from seriesmill.sources.csv import read_csv
from seriesmill.sources.files import find_inputs, scratch_folder

from .base import numbered, rounded, table

EVENTS = {"x": "ts", "y": ["value"]}


def _lines(name, job, tie=("event_id",), by=()):
    """The CSV lines of a job, without the header."""

    def run(spark, folder):
        df = numbered(spark, folder, name) if "pos" in tie else table(spark, folder, name)
        result = X.export_rows(df, Job.from_dict(job), by, tie)
        return X.csv_lines(X.csv_values(result), result).select(*by, "line")

    return run


def _values(name, job, tie=("event_id",), by=(), digits=9):
    """The typed columns of a job as exported."""

    def run(spark, folder):
        df = numbered(spark, folder, name) if "pos" in tie else table(spark, folder, name)
        values = X.csv_values(X.export_rows(df, Job.from_dict(job), by, tie))
        return rounded(values.drop(*[c for c in values.columns if c.startswith("_order")]), digits)

    return run


def _sources(spark, folder):
    """Events as if every user were a file of their own."""
    name = F.concat(F.lit("/data/"), F.col("event_type"), F.lit("/user_"), F.col("user_id").cast("string"), F.lit(".parquet"))
    return table(spark, folder, "events").withColumn("source", name)


def _float_text(spark, folder):
    df = table(spark, folder, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return df.select(
        cells.fixed_text(F.col("l_extendedprice"), 1).alias("one"), cells.fixed_text(net, 3).alias("three"),
        cells.fixed_text(F.col("l_quantity") / 8, 0).alias("whole"), cells.float_text(F.col("l_extendedprice")).alias("full"),
    )


def _round_trip(spark, folder):
    """Orders written as CSV, read back with inferred types."""
    job = Job.from_dict({"x": "o_orderdate", "y": ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority"], "csv": {"separator": ";", "decimal_comma": True}})
    target = scratch_folder(spark, "round-trip")
    X.write_csv(X.export_rows(numbered(spark, folder, "orders"), job), target)
    return read_csv(spark, target, ";", True).drop("source", "pos")


def _batch_files(spark, folder):
    """A batch over files of several kinds: typed events, CSV, other types, none of the columns, no Parquet; a kind has as many files as Spark has tasks for them."""
    events, target = table(spark, folder, "events"), scratch_folder(spark, "inputs")
    for kind in ("view", "click"):
        events.filter(F.col("event_type") == kind).write.parquet(f"{target}/{kind}.parquet")
    events.filter("event_type = 'purchase'").select("ts", F.col("value").cast("decimal(12,3)").alias("value"), "user_id").write.parquet(f"{target}/other.parquet")
    events.select("user_id").write.parquet(f"{target}/no.parquet")
    events.filter("user_id < 40").select("ts", "value").write.option("header", True).csv(f"{target}/texts.csv")
    events.filter("user_id < 9").select(F.col("props").alias("value")).write.text(f"{target}/broken.parquet")
    files = find_inputs(spark, [f"{target}/*/part-*"])
    job = Job.from_dict({"x": "ts", "y": ["value"], "output": {"path": "{dir}/{stem}.out"}})
    found = X.write_batch_files(spark, files, job, scratch_folder(spark, "batch")).manifest
    name = F.regexp_extract("source", "([a-z]+)[.](parquet|csv)/", 1)
    return found.groupBy(name.alias("name"), "status").agg(F.sum("rows").alias("rows")).select("name", "rows", "status")


def _texts_round_trip(spark, folder):
    """Whole documents, with their line breaks and quotes, written as CSV and read back with inferred types."""
    job = Job.from_dict({"x": "doc_id", "y": ["text", "lang", "source", "n_chars"]})
    target = scratch_folder(spark, "texts")
    docs = table(spark, folder, "documents")
    X.write_csv(X.export_rows(docs, job, tie=["doc_id"]), target)
    back = read_csv(spark, target, types={"doc_id": "integer", "text": "text", "lang": "text", "source": "text", "n_chars": "integer"}, source="file")
    return back.drop("file", "pos")


def _paths(spark, folder):
    """Output paths for every page address."""
    url = F.col("url")
    return table(spark, folder, "pages").select(
        "page_id",
        X.output_path("{stem}_export.csv", url).alias("beside"),
        X.output_path("/out/{parent}/{stem}_{range}.csv", url, F.concat(F.lit("part "), F.col("page_id").cast("string"), F.lit(" (a/b)"))).alias("split"),
        X.output_path("{name}.csv", url, None, "/results").alias("based"),
    )


def _batch(spark, folder):
    """One job over all users at once: relative ranges, 12-hour buckets."""
    job = Job.from_dict({
        **EVENTS, "range_mode": "relative", "ranges": [["1d", "15d"]],
        "aggregation": {"method": "interval", "every": "12h", "functions": ["mean", "max", "count"]},
    })
    return rounded(process(_sources(spark, folder), job, ["source"], ["event_id"]))


def _manifest(spark, folder):
    """The batch written as CSV, one output per source and range, with its row counts."""
    job = Job.from_dict({
        **EVENTS, "range_mode": "relative", "ranges": [[0, "2d", "start"], ["3d", "3d1h"]],
        "output": {"split_ranges": True, "path": "{stem}.csv"},
    })
    target = scratch_folder(spark, "batch")
    name = F.concat(F.lit("/data/"), F.col("event_type"), F.lit(".parquet"))
    events = table(spark, folder, "events").withColumn("source", name)
    return X.write_batch(events, job, target, tie=["event_id"]).manifest


def _resume(spark, folder):
    """The lines of each output after a batch and its resume into the same folder, which skips what is done."""
    job = Job.from_dict({**EVENTS, "output": {"path": "{stem}.csv"}})
    target = scratch_folder(spark, "resume")
    name = F.concat(F.lit("/data/"), F.col("event_type"), F.lit(".parquet"))
    events = table(spark, folder, "events").withColumn("source", name)
    first = X.write_batch(events.filter("event_type < 'p'"), job, target, tie=["event_id"])
    X.write_batch(events, job, target, tie=["event_id"], skip=first.manifest.filter("status = 'written'"))
    return spark.read.text(target).groupBy(F.col("output").cast("string").alias("output")).agg(F.count(F.lit(1)).alias("lines"))


def _placed(spark, folder):
    """The lines of each output, read from its own path after the batch was moved there twice."""
    job = Job.from_dict({**EVENTS, "output": {"path": "{stem} of {parent}.csv"}})
    target = scratch_folder(spark, "placed")
    name = F.concat(F.lit(f"{target}/day 1/"), F.col("event_type"), F.lit(".parquet"))
    events = table(spark, folder, "events").withColumn("source", name)
    for part in (events.filter("event_type < 'p'"), events):
        X.place_outputs(spark, X.write_batch(part, job, f"{target}/batch", tie=["event_id"]))
    lines = spark.read.option("recursiveFileLookup", "true").text(f"{target}/day 1")
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return lines.groupBy(F.regexp_extract(path, "/day 1/(.*)/part-", 1).alias("output")).agg(F.count(F.lit(1)).alias("lines"))


def _dry(spark, folder):
    job = Job.from_dict({**EVENTS, "aggregation": {"method": "every_nth", "n": 4}})
    return X.dry_run(_sources(spark, folder), job, tie=["event_id"])


CONFIG = """{
  "version": 1, "x": "o_orderdate", "y": ["o_totalprice", "o_orderpriority"],
  "scaling": {"o_totalprice": {"scale": 0.001}}, "range_mode": "absolute",
  "ranges": [{"start": "1996-01-01T00:00:00", "end": "1998-06-30T00:00:00", "label": "middle", "color": "#ff8800"}],
  "aggregation": {"method": "bucket", "every": "1q", "functions": "mean, max"}, "sort": true,
  "csv": {"separator": "tab", "time_format": "custom", "datetime_format": "%Y/%m/%d", "float_precision": 3, "rename": {"o_totalprice_mean": "mean [k]"}},
  "output": {"path": "{stem}_export.csv", "split_ranges": false}
}"""


def _config(spark, folder):
    """A whole JSON job, from table to formatted lines."""
    job = Job.from_json(Job.from_json(CONFIG).to_json())
    result = X.export_rows(numbered(spark, folder, "orders"), job)
    return X.csv_lines(X.csv_values(result), result).select("line")


QUERIES = {
    "time_iso": (
        _lines("events", EVENTS),
        "SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || ',' || value::VARCHAR AS line FROM events",
    ),
    "time_custom": (
        _lines("events", {**EVENTS, "csv": {"time_format": "custom", "datetime_format": "%d.%m.%Y %H:%M:%S%.3f (day %j)"}}),
        "SELECT strftime(ts, '%d.%m.%Y %H:%M:%S.%g (day %j)') || ',' || value::VARCHAR AS line FROM events",
    ),
    "time_custom_weeks": (
        _lines("events", {**EVENTS, "csv": {"time_format": "custom", "datetime_format": "%e|%-d|%j|%u|%w|%U|%W|%G-W%V|%I %p %P|%s|%C%y|%c%.f"}}),
        """SELECT lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, '|%-d|%j|%u|%w|%U|%W|%G-W%V|%I %p ') || lower(strftime(ts, '%p')) || '|' || (epoch_us(ts) // 1000000) || strftime(ts, '|%Y|%a %b ')
           || lpad(day(ts)::VARCHAR, 2, ' ') || strftime(ts, ' %H:%M:%S %Y') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' WHEN epoch_us(ts) % 1000 = 0 THEN strftime(ts, '.%g') ELSE strftime(ts, '.%f') END
           || ',' || value::VARCHAR AS line FROM events""",
    ),
    "time_epoch_s": (
        _values("events", {**EVENTS, "csv": {"time_format": "epoch_s"}}),
        "SELECT epoch_us(ts) / 1e6::DOUBLE AS ts, value FROM events",
    ),
    "time_epoch_ms": (
        _values("events", {**EVENTS, "csv": {"time_format": "epoch_ms"}}),
        "SELECT epoch_us(ts) // 1000 AS ts, value FROM events",
    ),
    "time_elapsed": (
        _values("events", {**EVENTS, "ranges": [["2024-01-10", None]], "csv": {"time_format": "elapsed_s"}}),
        "SELECT round((epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6::DOUBLE, 9) AS ts, value FROM events WHERE ts >= TIMESTAMP '2024-01-10'",
    ),
    "time_elapsed_per_user": (
        _values("events", {**EVENTS, "aggregation": {"method": "interval", "every": "1d", "functions": ["max"]}, "csv": {"time_format": "elapsed_s"}}, by=("user_id",)),
        """WITH b AS (SELECT user_id, epoch_us(min(ts)) AS a FROM events GROUP BY 1)
           SELECT e.user_id, round((epoch_us(date_trunc('day', ts)::TIMESTAMP) - a) / 1e6::DOUBLE, 9) AS ts, max(value) AS value
           FROM events e JOIN b ON e.user_id = b.user_id GROUP BY 1, 2""",
    ),
    "rename_headers": (
        _values("orders", {"x": "o_orderdate", "y": ["o_totalprice"], "aggregation": {"method": "interval", "every": "1y", "functions": ["mean", "count"]},
                           "csv": {"rename": {"o_totalprice_mean": "price", "o_orderdate": "year", "absent": "nothing"}}}, ("o_orderkey",), digits=6),
        """SELECT date_trunc('year', o_orderdate)::TIMESTAMP AS "year", round(avg(o_totalprice), 6) AS price, count(o_totalprice) AS o_totalprice_count FROM orders GROUP BY 1""",
    ),
    "float_precision": (
        _float_text,
        """SELECT printf('%.1f', l_extendedprice) AS one, printf('%.3f', l_extendedprice * (1 - l_discount)) AS three,
           printf('%.0f', l_quantity / 8) AS whole, l_extendedprice::VARCHAR AS "full" FROM lineitem""",
    ),
    "decimal_comma": (
        _lines("customer", {"x": "c_acctbal", "y": ["c_custkey", "c_mktsegment"], "csv": {"separator": ";", "decimal_comma": True}}, ("c_custkey",)),
        "SELECT replace(c_acctbal::VARCHAR, '.', ',') || ';' || c_custkey || ';' || c_mktsegment AS line FROM customer",
    ),
    "csv_lines": (
        _lines("documents", {"x": "doc_id", "y": ["lang", "text", "n_chars"], "csv": {"quote_style": "necessary", "null_value": "NA"}}, ("doc_id",)),
        """SELECT doc_id || ',' || lang || ',' || CASE WHEN text = '' OR contains(text, '"') OR contains(text, ',') OR contains(text, chr(10)) OR contains(text, chr(13))
           THEN '"' || replace(text, '"', '""') || '"' ELSE text END || ',' || n_chars AS line FROM documents""",
    ),
    "csv_lines_non_numeric": (
        _lines("events", {"x": "ts", "y": ["value", "props", "user_id"], "csv": {"quote_style": "non_numeric", "separator": "tab"}}),
        """SELECT '"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"' || chr(9) || value::VARCHAR || chr(9) || '"' || replace(props, '"', '""') || '"' || chr(9) || user_id AS line FROM events""",
    ),
    "batch_files": (
        _batch_files,
        """SELECT 'view' AS name, count(*) AS rows, 'written' AS status FROM events WHERE event_type = 'view' UNION ALL SELECT 'click', count(*), 'written' FROM events WHERE event_type = 'click'
           UNION ALL SELECT 'other', count(*), 'written' FROM events WHERE event_type = 'purchase' UNION ALL SELECT 'texts', count(*), 'written' FROM events WHERE user_id < 40
           UNION ALL SELECT 'no', NULL, 'failed' UNION ALL SELECT 'broken', NULL, 'failed'""",
    ),
    "csv_texts_round_trip": (_texts_round_trip, "SELECT doc_id, text, lang, source, n_chars FROM documents"),
    "csv_round_trip": (
        _round_trip,
        "SELECT o_orderdate, o_orderkey, o_totalprice, o_orderstatus, o_orderpriority FROM orders",
    ),
    "output_paths": (
        _paths,
        r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '[^/]*$') AS name, regexp_replace(url, '/[^/]*$', '') AS dir FROM pages),
           q AS (SELECT *, regexp_replace(name, '^(.+)\.[^.]+$', '\1') AS stem, regexp_extract(dir, '[^/]*$') AS parent FROM p)
           SELECT page_id, dir || '/' || stem || '_export.csv' AS beside, '/out/' || parent || '/' || stem || '_part_' || page_id || '_a_b.csv' AS split,
           '/results/' || name || '.csv' AS based FROM q""",
    ),
    "batch_interval": (
        _batch,
        """WITH e AS (SELECT '/data/' || event_type || '/user_' || user_id || '.parquet' AS source, ts, value FROM events),
           b AS (SELECT source, min(ts) AS a FROM e GROUP BY 1)
           SELECT e.source, time_bucket(INTERVAL '12 hours', ts) AS ts, round(avg(value), 9) AS value_mean, max(value) AS value_max, count(value) AS value_count
           FROM e JOIN b ON e.source = b.source WHERE ts BETWEEN a + INTERVAL '1 day' AND a + INTERVAL '15 days' GROUP BY 1, 2""",
    ),
    "batch_manifest": (
        _manifest,
        """WITH e AS (SELECT '/data/' || event_type || '.parquet' AS source, ts FROM events),
           b AS (SELECT source, min(ts) AS a FROM e GROUP BY 1),
           c AS (SELECT b.source, count(*) FILTER (ts <= a + INTERVAL '2 days') AS n1, count(*) FILTER (ts BETWEEN a + INTERVAL '3 days' AND a + INTERVAL '73 hours') AS n2
                 FROM e JOIN b ON e.source = b.source GROUP BY 1)
           SELECT source, 'start' AS range, replace(source, '.parquet', '_start.csv') AS output, n1 AS rows, 'written' AS status, NULL::VARCHAR AS error FROM c
           UNION ALL SELECT source, '2', replace(source, '.parquet', '_2.csv'), n2, 'written', NULL FROM c""",
    ),
    "batch_placed": (_placed, "SELECT event_type || ' of day 1.csv' AS output, count(*) + 1 AS lines FROM events GROUP BY event_type"),
    "batch_resume": (_resume, "SELECT '/data/' || event_type || '.csv' AS output, count(*) + 1 AS lines FROM events GROUP BY event_type"),
    "dry_run_plan": (
        _dry,
        """SELECT '/data/' || event_type || '/user_' || user_id || '.parquet' AS source, '/data/' || event_type || '/user_' || user_id || '_export.csv' AS output,
           'all' AS range, ceil(count(*) / 4)::BIGINT AS estimate FROM events GROUP BY event_type, user_id""",
    ),
    "config_job": (
        _config,
        """SELECT strftime(date_trunc('quarter', o_orderdate), '%Y/%m/%d') || chr(9) || printf('%.3f', avg(o_totalprice * 0.001::DOUBLE)) || chr(9)
           || printf('%.3f', max(o_totalprice * 0.001::DOUBLE)) || chr(9) || max(o_orderpriority) AS line FROM orders
           WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-06-30' GROUP BY date_trunc('quarter', o_orderdate)""",
    ),
}
