"""The registered queries of this package."""

from __future__ import annotations

import functools

from . import alignment, decontamination, extraction, graph_search, mixing, packing, ppm, quality, simhash, suffixes, vector_codes, vector_links, warc
from .shared import shipped

MODULES = (vector_links, extraction, ppm, warc, suffixes, quality, graph_search, mixing, simhash, packing, vector_codes, alignment, decontamination)


def queries():
    return {name: _ready(run) for module in MODULES for name, (run, _) in module.QUERIES.items()}


def _ready(run):
    """*run* with the package on all workers."""
    return functools.wraps(run)(lambda spark, folder: run(shipped(spark), folder))


def oracle_sql():
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
