"""Helpers shared by the registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seriesmill import Job, process
from seriesmill.sources.files import read_parquet

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def numbered(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table with its row number as ``pos``."""
    return read_parquet(spark, f"{folder}/{name}.parquet").drop("source")


def rounded(df: DataFrame, digits: int = 9, only: tuple[str, ...] = ()) -> DataFrame:
    """Doubles rounded, so that the order of additions does not show."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType) and (not only or f.name in only)]
    return df.withColumns({name: F.round(name, digits) for name in names}) if names else df


def job_query(
    name: str, job: dict, by: tuple[str, ...] = (), tie: tuple[str, ...] = ("event_id",), digits: int = 9,
    derive: Callable[[DataFrame], DataFrame] | None = None, **options,
) -> Query:
    """A job over one table; *derive* adds columns first."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = numbered(spark, folder, name) if "pos" in tie else table(spark, folder, name)
        df = derive(df) if derive else df
        return rounded(process(df, Job.from_dict(job), by, tie, **options), digits)

    return run
