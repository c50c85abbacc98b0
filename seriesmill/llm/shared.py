"""Helpers of this package: tables, written intermediate results, texts as byte arrays."""

from __future__ import annotations

import ctypes
import pathlib
import tempfile
import uuid
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shipped(spark: SparkSession) -> SparkSession:
    """*spark*, with this package sent to its workers, once per application, so that they need no path to it."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = pathlib.Path(__file__).resolve().parents[2]
        archive = f"{tempfile.mkdtemp(prefix='seriesmill-')}/seriesmill.zip"  # Spark's own file server takes it from here
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted((root / "seriesmill").rglob("*.py")):
                out.write(path, path.relative_to(root))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark


_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors see; only a local session may go without the setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="seriesmill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def saved(df: DataFrame) -> DataFrame:
    """*df* written as a table in the shared folder and read back, so that lost executors cost no more than this."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def byte_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (NULL as empty) and the offsets of its rows, without a copy where possible."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def hand_back():
    """Gives memory that a worker no longer needs back to the system; workers serve stage after stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def row_starts(offsets: np.ndarray, size: int) -> np.ndarray:
    """A flag for each byte that is the first of its row."""
    flags = np.zeros(size + 1, dtype=bool)
    flags[offsets[:-1]] = True
    return flags[:size]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs without white space, within a row), and the number of words before each row."""
    inside = ~SPACES[data]
    first = row_starts(offsets, len(data))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:]
    stops = inside.copy()
    stops[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def by_bytes(batch: pa.RecordBatch, column: int, size: int = 1 << 20):
    """Slices of *batch* with about *size* bytes of text each, one row at least; small ones keep a task's arrays small."""
    lengths = np.diff(byte_view(batch.column(column))[1])
    ends = np.cumsum(lengths)
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + size, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end
    pa.default_memory_pool().release_unused()
