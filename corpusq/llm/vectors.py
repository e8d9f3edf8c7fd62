"""What the vector operators share: valid vectors, equal vectors as one class, Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, *more: str) -> DataFrame:
    """vec_id and embedding (array<double>) of rows that take part.

    Out are rows without id, null or empty vectors, vectors with null or
    non-finite components and zero vectors.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *more, v.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column whose lists have one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def lengths(column) -> np.ndarray:
    return np.asarray(pa.compute.list_value_length(column))
