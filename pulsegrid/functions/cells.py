"""Cells, voxels and comparisons that treat NaN as the point-cloud world does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell(value: Column | str, size: float, origin: float = 0.0) -> Column:
    """Number of the cell that holds a value: closed below, open above."""
    return F.floor((col(value) - F.lit(float(origin))) / F.lit(float(size)))


def finite(value: Column | str) -> Column:
    v = col(value)
    return v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != F.lit(float("inf")))


def compare(a: Column | str, op: str, b: Column | str) -> Column:
    """IEEE comparison: with NaN on either side only ``!=`` holds (Spark ranks NaN highest)."""
    x, y = col(a).cast("double"), col(b).cast("double")
    known = ~F.isnan(x) & ~F.isnan(y)
    if op == "!=":
        return ~known | (x != y)
    holds = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "==": x == y}[op]
    return known & holds


def between(value: Column | str, low: float | None, high: float | None) -> Column:
    """Inclusive bounds; a missing bound is open."""
    out = F.lit(True)
    if low is not None:
        out = out & compare(value, ">=", F.lit(float(low)))
    if high is not None:
        out = out & compare(value, "<=", F.lit(float(high)))
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, null where b is 0."""
    return F.when(col(b) != 0, col(a) / col(b))


def around(df: DataFrame, keys: list[str], reach: int = 1) -> DataFrame:
    """Each row once for every cell up to ``reach`` away along each key."""
    steps = F.array(*[F.lit(i).cast("long") for i in range(-reach, reach + 1)])
    for k in keys:
        df = df.withColumn("step", F.explode(steps)).withColumn(k, F.col(k) + F.col("step")).drop("step")
    return df
