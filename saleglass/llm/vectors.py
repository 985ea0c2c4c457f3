"""Vectors of numbers as whole numbers, shared by the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole(vector: Column, factor: int, limit: int) -> Column:
    """floor(factor * x) of every component, in doubles, held between -``limit`` and ``limit``."""
    return F.transform(
        vector,
        lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(factor)), F.lit(float(-limit))), F.lit(float(limit)))).cast("int"),
    )


def finite(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is there and holds finite numbers only."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return df.where(F.col(vector_col).isNotNull() & ~bad)


def matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of whole numbers as rows of int64, shorter lists filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.asarray(column.value_lengths().fill_null(0), np.int64)
    flat = np.asarray(column.flatten(), np.int64)
    longest = int(sizes.max(initial=0)) if width is None else width
    if len(sizes) and (sizes == longest).all():
        return flat.reshape(len(sizes), longest)
    out = np.zeros((len(sizes), longest), np.int64)
    out[np.arange(longest) < sizes[:, None]] = flat
    return out
