"""What the operators on embeddings share: rows with a number of their own, packed vectors, and blocks of bounded size."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stage


def sound(column: str = "embedding"):
    """Vectors that are not null and hold finite components only."""
    c = F.col(column).cast("array<double>")
    bad = F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return c.isNotNull() & ~bad


def numbered(vectors: DataFrame, *columns: str) -> DataFrame:
    """Sound rows as ``uid, vec_id, embedding`` and ``columns``; a written table, so that ``uid`` stays.

    ``uid`` tells rows apart that share a ``vec_id`` or even all values.
    """
    bounded_batches(vectors.sparkSession)
    cols = [F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), *columns]
    return stage(vectors.filter(sound()).select(F.monotonically_increasing_id().alias("uid"), *cols), "vectors")


def matrix(column: pa.ListArray) -> np.ndarray:
    """Vectors as rows, those that are shorter filled up with zeros."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8")
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def padded(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))

