"""The registered queries: each with its Spark callable and, where SQL can say it, its oracle."""

from __future__ import annotations

from . import buckets, display, inputs, outputs, ranges, rows

MODULES = (inputs, rows, ranges, buckets, display, outputs)


def queries():
    return {name: run for module in MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
