"""Sources: profiles, file facts, CSV analysis and typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from seriesmill import Job
from seriesmill.operators.bounds import column_profile
from seriesmill.plans.export import split_own_outputs, without_done, planned_outputs
from seriesmill.sources import csv as C
from seriesmill.operators.normalise import interval_seconds
from seriesmill.sources.files import find_inputs, inventory, with_units

from .base import numbered, table


def _inventory(spark, folder):
    files = find_inputs(spark, [folder])
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return inventory(files).select(name.alias("name"), "format", (F.col("size") > 0).alias("stored"), "rows")


def _file_rows(spark, folder):
    """Rows per table file."""
    return _inventory(spark, folder).select("name", "format", "rows")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _profile(spark, folder):
    return column_profile(table(spark, folder, "orders")).withColumn("mean", F.round("mean", 6))


def _dialects(spark, folder):
    """The dialect of every document, taken as one CSV file each."""
    docs = table(spark, folder, "documents")
    return C.text_dialects(docs, ["doc_id"], "text")


DIALECT_SQL = r"""
    WITH h AS (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(text, '^\x{FEFF}', ''), '\r\n|\n|\r'), lambda l: trim(l) <> '') AS ls FROM documents),
    bare AS (SELECT doc_id, ls, list_transform(ls, lambda l: regexp_replace(l, '"[^"]*"?', '', 'g')) AS bs FROM h),
    c AS (SELECT doc_id, ls, list_transform(bs, lambda l: length(l) - length(replace(l, ',', ''))) AS c1, list_transform(bs, lambda l: length(l) - length(replace(l, ';', ''))) AS c2,
          list_transform(bs, lambda l: length(l) - length(replace(l, chr(9), ''))) AS c3, list_transform(bs, lambda l: length(l) - length(replace(l, '|', ''))) AS c4 FROM bare),
    s AS (SELECT doc_id, ls, unnest([{'r': 0, 'p': ',', 'c': c1}, {'r': -1, 'p': ';', 'c': c2}, {'r': -2, 'p': chr(9), 'c': c3}, {'r': -3, 'p': '|', 'c': c4}]) AS k FROM c),
    b AS (SELECT doc_id, coalesce(arg_max(k.p, (len(list_distinct(k.c)) = 1, k.c[1], k.r)) FILTER (k.c[1] > 0), ',') AS separator, any_value(ls) AS ls FROM s GROUP BY 1),
    f AS (SELECT doc_id, separator, list_transform(flatten(list_transform(ls[2:], lambda l: string_split(l, separator))),
          lambda f: regexp_replace(regexp_replace(f, '^\s+|\s+$', '', 'g'), '^"+|"+$', '', 'g')) AS fs FROM b)
    SELECT doc_id, separator, separator <> ',' AND len(list_filter(fs, lambda f: regexp_matches(f, '^[+-]?[0-9]+,[0-9]+$'))) > 0
      AND len(list_filter(fs, lambda f: regexp_matches(f, '^[+-]?[0-9]*\.[0-9]+$'))) = 0 AS decimal_comma FROM f
"""


def _cells(spark, folder):
    """Events as a European CSV would hold them: texts, decimal commas, odd cells."""
    df = numbered(spark, folder, "events")
    odd = F.col("event_id") % 11
    return df.select(
        "event_id",
        F.col("pos"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"),
        F.when(odd == 3, "NA").when(odd == 4, "").otherwise(F.replace(F.col("value").cast("string"), F.lit("."), F.lit(","))).alias("value"),
        F.when(odd == 5, "N/A").otherwise(F.col("user_id").cast("string")).alias("user"),
        F.when(F.col("value") > 50, "true").otherwise("false").alias("high"),
        F.when(odd == 6, "#N/A").otherwise(F.col("event_type")).alias("kind"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


COLUMNS = ["at", "value", "user", "high", "kind", "day"]
TYPES = {"at": "datetime", "value": "float", "user": "integer", "high": "boolean", "kind": "text", "day": "date"}


def _typed(spark, folder):
    return C.typed(_cells(spark, folder), TYPES, ["event_id"], decimal_comma=True)


def _infer(spark, folder):
    counts = C.cell_classes(_cells(spark, folder), COLUMNS, (), decimal_comma=True)
    return C.infer_types(counts, COLUMNS).select("column", "type", "rows")


def _late(spark, folder):
    """Per event type, cells whose later rows no longer fit what the first rows looked like."""
    df = numbered(spark, folder, "lineitem")
    late = F.col("pos") >= 4000
    cells = df.select(
        "l_linestatus", "pos",
        F.when(late & (F.col("l_linenumber") == 5), "2.5").otherwise(F.col("l_orderkey").cast("string")).alias("n"),
        F.when(late & (F.col("l_linenumber") == 3), "yesterday").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("t"),
        F.when(late & (F.col("l_linenumber") == 2), "2000-01-01 00:00:00").otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("d"),
        F.when(late, "maybe").otherwise("true").alias("flag"),
        F.col("l_tax").cast("string").alias("v"),
    )
    columns = ["n", "t", "d", "flag", "v"]
    counts = C.cell_classes(cells, columns, ["l_linestatus"])
    return C.infer_types(counts, columns, ["l_linestatus"])


def _paths(spark, folder):
    """One input file per document, some of them results of earlier exports."""
    docs = table(spark, folder, "documents")
    earlier = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), (F.col("doc_id") + 1).cast("string"), F.lit("_export.csv")))
    return docs.select(F.coalesce(earlier, F.concat(F.lit("/data/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".csv"))).alias("source"))


PATHS_SQL = """WITH p AS (SELECT CASE WHEN doc_id % 5 = 0 THEN '/data/' || source || '/' || (doc_id + 1) || '_export.csv'
    ELSE '/data/' || source || '/' || doc_id || '.csv' END AS source FROM documents),
    o AS (SELECT regexp_replace(source, '\\.csv$', '_export.csv') AS source FROM p)"""


def _own(spark, folder):
    return split_own_outputs(_paths(spark, folder), Job.from_dict({"x": "a", "y": ["b"]}))[0]


def _done(spark, folder):
    """Outputs still to write when an earlier run wrote those of the labelled documents."""
    job = Job.from_dict({"x": "a", "y": ["b"], "output": {"path": "out/{parent}_{stem}.csv"}})
    docs = table(spark, folder, "documents")
    path = F.concat(F.lit("/data/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".parquet"))
    planned = planned_outputs(docs.select(path.alias("source")), job)
    labelled = docs.join(table(spark, folder, "labels"), "doc_id")
    done = planned_outputs(labelled.select(path.alias("source")), job).select("output", F.lit("written").alias("status"))
    return without_done(planned, done).select("source", "output")


def _units(spark, folder):
    """Times and durations that a file holds as whole numbers of some unit."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    stored = table(spark, folder, "events").select("event_id", (us * 1000 + F.col("event_id") % 1000).alias("ns"), F.floor(us / 1_000_000).alias("s"), (F.col("event_id") - 500).alias("took"))
    found = with_units(stored, {"ns": "ns", "s": "s", "took": "duration ms"})
    return found.select("event_id", "ns", "s", interval_seconds(F.col("took")).alias("took"))


QUERIES = {
    "stored_units": (
        _units,
        "SELECT event_id, ts AS ns, date_trunc('second', ts)::TIMESTAMP AS s, (event_id - 500) / 1000.0::DOUBLE AS took FROM events",
    ),
    "file_inventory": (
        _inventory,
        " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, 'parquet' AS format, true AS stored, count(*) AS rows FROM {t}" for t in TABLES),
    ),
    "file_rows": (
        _file_rows,
        " UNION ALL ".join(f"SELECT '{t}.parquet' AS name, 'parquet' AS format, count(*) AS rows FROM {t}" for t in TABLES),
    ),
    "column_profile": (
        _profile,
        """SELECT 'o_orderkey' AS "column", 'numeric' AS kind, count(*) FILTER (o_orderkey IS NULL) AS nulls, min(o_orderkey)::DOUBLE AS min_number, max(o_orderkey)::DOUBLE AS max_number,
             NULL::TIMESTAMP AS min_time, NULL::TIMESTAMP AS max_time, round(avg(o_orderkey), 6) AS mean FROM orders
           UNION ALL SELECT 'o_custkey', 'numeric', count(*) FILTER (o_custkey IS NULL), min(o_custkey)::DOUBLE, max(o_custkey)::DOUBLE, NULL, NULL, round(avg(o_custkey), 6) FROM orders
           UNION ALL SELECT 'o_orderstatus', 'text', count(*) FILTER (o_orderstatus IS NULL), NULL, NULL, NULL, NULL, NULL FROM orders
           UNION ALL SELECT 'o_totalprice', 'numeric', count(*) FILTER (o_totalprice IS NULL), min(o_totalprice), max(o_totalprice), NULL, NULL, round(avg(o_totalprice), 6) FROM orders
           UNION ALL SELECT 'o_orderdate', 'datetime', count(*) FILTER (o_orderdate IS NULL), NULL, NULL, min(o_orderdate), max(o_orderdate), NULL FROM orders
           UNION ALL SELECT 'o_orderpriority', 'text', count(*) FILTER (o_orderpriority IS NULL), NULL, NULL, NULL, NULL, NULL FROM orders""",
    ),
    "csv_dialect": (_dialects, DIALECT_SQL),
    "csv_typed_projection": (
        _typed,
        """SELECT event_id, ts AS at, CASE WHEN event_id % 11 NOT IN (3, 4) THEN value END AS value, CASE WHEN event_id % 11 <> 5 THEN user_id END AS "user",
           value > 50 AS high, CASE WHEN event_id % 11 <> 6 THEN event_type END AS kind, ts::DATE AS day FROM events""",
    ),
    "csv_infer_types": (
        _infer,
        """SELECT unnest(['at', 'value', 'user', 'high', 'kind', 'day']) AS "column", unnest(['datetime', 'float', 'integer', 'boolean', 'text', 'date']) AS type,
           (SELECT count(*) FROM events) AS rows""",
    ),
    "csv_widen_types": (
        _late,
        """WITH s AS (SELECT l_linestatus, count(*) AS rows FROM lineitem GROUP BY 1)
           SELECT l_linestatus, unnest(['n', 't', 'd', 'flag', 'v']) AS "column",
           unnest(['float', 'text', 'text', 'text', 'float']) AS type, rows FROM s""",
    ),
    "exclude_own_outputs": (_own, PATHS_SQL + " SELECT source FROM p WHERE source NOT IN (SELECT source FROM o)"),
    "skip_done_sources": (
        _done,
        """SELECT '/data/' || lang || '/' || doc_id || '.parquet' AS source, '/data/' || lang || '/out/' || lang || '_' || doc_id || '.csv' AS output
           FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    ),
}
