"""Helpers for tables of embedding vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import quoted


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null, not empty, all components finite, one of them not zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def vectors_of(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``(vec_id, vector, usable)`` whatever else the table holds."""
    return rows.select(quoted(key).cast("long").alias("vec_id"), quoted(vector).alias("vector")).withColumn(
        "usable", usable(F.col("vector")))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Equally long lists as the rows of a matrix in double precision."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks)
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(array), -1) if len(array) else flat.reshape(0, 1)


def units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows at length one, and their lengths. Scaled first, so that no square over- or underflows."""
    scale = np.abs(x).max(axis=1, keepdims=True)
    y = x / scale
    length = np.sqrt((y * y).sum(axis=1, keepdims=True))
    return y / length, (length * scale)[:, 0]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row cosine of unit vectors, the same for the same rows wherever they stand."""
    return np.minimum((x * y).sum(axis=1), 1.0)
