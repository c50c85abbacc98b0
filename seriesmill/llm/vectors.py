"""What the operators on vectors share: which vectors take part, and vectors as arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vector: str):
    """Not NULL, not empty, not all zero, and no component NULL, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def narrowed(df: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, vector) with doubles; zeros have one sign."""
    return df.select(df[id].alias("id"), F.transform(df[vector], lambda x: x.cast("double") + F.lit(0.0)).alias("vector"))


def matrix(column) -> np.ndarray:
    """A list column whose rows are equally long, as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, without overflow on the way."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def by_length(lengths: np.ndarray):
    """Row numbers of each vector length."""
    for length in np.unique(lengths):
        yield int(length), np.flatnonzero(lengths == length)
