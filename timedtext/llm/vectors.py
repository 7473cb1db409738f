"""Checks and layouts of vectors that the operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(v: Column) -> Column:
    """Not null, without null or non-finite components, and not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Lists of equal length as the rows of a float64 matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two each, so that their largest component is from 0.5 to 1, and the powers: squares of such rows neither over- nor underflow."""
    _, power = np.frexp(np.abs(x).max(axis=1)) if x.size else (None, np.zeros(len(x), np.int32))
    # in two steps, as the power of a number near the smallest one is more than a factor can be
    half = power // 2
    return np.ldexp(np.ldexp(x, -half[:, None]), (half - power)[:, None]), power.astype(np.int64)


def distinct_vectors(df: DataFrame, *by: str) -> DataFrame:
    """The usable vectors, once for each value of `by`, with their number of components as dim and their rows counted as copies."""
    return df.filter(usable(F.col("embedding"))).groupBy(*by, "embedding").agg(F.count("*").alias("copies"), F.min("vec_id").alias("first_id")).withColumn("dim", F.size("embedding"))
