"""Run registered queries next to their DuckDB oracles: python tests/compare.py SF_DIR [name …]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def session(cores: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(spark, con, folder, name, run, sql) -> str:
    """An empty text when both sides agree, else what differs."""
    df = run(spark, folder)
    names, got = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return ""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    other, want = canonical(columns, cursor.fetchall())
    if names != other:
        return f"columns {names} != {other}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(got, want):
        if repr(a) != repr(b):
            return f"value {a} != {b}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as entry

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark, con = session(), connect(folder)
    oracle, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            problem = compare(spark, con, folder, name, run, oracle.get(name))
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += bool(problem)
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if not problem else 'DIFF ' + problem}", flush=True)
    print("different:", bad)
