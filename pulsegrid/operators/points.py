"""Selecting, thinning, moving and merging points.

Points are rows ``pid, x, y, z`` and attributes; ``pid`` stands for the order
of the points, which decides ties.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import between, cell


def where(points: DataFrame, condition: Column | str) -> DataFrame:
    return points.filter(condition)


def crop_box(points: DataFrame, low, high, invert: bool = False) -> DataFrame:
    """Points in a box with inclusive bounds; None leaves a side open."""
    inside = reduce(lambda a, b: a & b, [between(c, lo, hi) for c, lo, hi in zip("xyz", low, high, strict=True)])
    return points.filter(~inside if invert else inside)


def crop_cylinder(points: DataFrame, x: float, y: float, radius: float, low: float | None = None, high: float | None = None, invert: bool = False) -> DataFrame:
    dx, dy = F.col("x") - x, F.col("y") - y
    inside = (dx * dx + dy * dy <= radius * radius) & between("z", low, high)
    return points.filter(~inside if invert else inside)


def crop_range(points: DataFrame, origin, low: float | None, high: float | None) -> DataFrame:
    """A shell around an origin."""
    d = F.sqrt(sum(((F.col(c) - o) * (F.col(c) - o) for c, o in zip("xyz", origin, strict=True)), F.lit(0.0)))
    return points.filter(between(d, low, high))


def random_points(points: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n points without replacement, in order of a seeded digest of their pid."""
    key = F.md5(F.concat(F.col("pid").cast("string"), F.lit(f":{seed}")))
    return points.withColumn("draw", key).orderBy("draw", "pid").limit(n).drop("draw")


def voxels(points: DataFrame, size: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Points with their voxel ``ix, iy, iz``."""
    return points.withColumns({f"i{c}": cell(c, size, o) for c, o in zip("xyz", origin, strict=True)})


def voxel_first(points: DataFrame, size: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """The first point of each voxel; one aggregate, combined before the shuffle."""
    keyed = voxels(points, size, origin)
    row = F.struct("pid", *[c for c in points.columns if c != "pid"])
    return keyed.groupBy("ix", "iy", "iz").agg(F.min_by(row, "pid").alias("p")).select(*[F.col(f"p.{c}").alias(c) for c in points.columns])


def voxel_centroid(points: DataFrame, size: float, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """The mean point of each voxel and its count; attributes have no mean here."""
    return voxels(points, size, origin).groupBy("ix", "iy", "iz").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"), F.count("*").alias("n"))


def decimate_highest(points: DataFrame, size: float) -> DataFrame:
    """The highest point of each cell; of equals the first."""
    keyed = points.withColumns({"col": cell("x", size), "row": cell("y", size)})
    row = F.struct(*points.columns)
    best = keyed.groupBy("row", "col").agg(F.max_by(row, F.struct("z", -F.col("pid"))).alias("p"))
    return best.select(*[F.col(f"p.{c}").alias(c) for c in points.columns])


def decimate_random(points: DataFrame, fraction: float, size: float, seed: int = 0) -> DataFrame:
    """round(fraction * n) points of each tile, by a seeded digest.

    The tile's points are ranked in blocks of their digest's first two digits,
    so that no task sorts a whole tile: blocks under the cut go whole, and only
    the block that holds the cut is ranked.
    """
    tile = {"tx": cell("x", size), "ty": cell("y", size)}
    keyed = points.withColumns(tile).withColumn("draw", F.md5(F.concat(F.col("pid").cast("string"), F.lit(f":{seed}"))))
    keyed = keyed.withColumn("block", F.substr("draw", F.lit(1), F.lit(2)))
    counts = keyed.groupBy("tx", "ty", "block").agg(F.count("*").alias("n"))
    w = Window.partitionBy("tx", "ty")
    cut = counts.select(
        "tx", "ty", "block",
        (F.sum("n").over(w.orderBy("block")) - F.col("n")).alias("before"),
        F.round(F.sum("n").over(w) * F.lit(fraction)).cast("long").alias("keep"),
    )
    rank = F.row_number().over(Window.partitionBy("tx", "ty", "block").orderBy("draw", "pid"))
    out = keyed.join(cut, ["tx", "ty", "block"]).filter("before < keep").withColumn("rank", rank)
    return out.filter(F.col("before") + F.col("rank") <= F.col("keep")).select(*points.columns)


def transform(points: DataFrame, matrix) -> DataFrame:
    """Apply a 4 x 4 homogeneous matrix."""
    m = np.asarray(matrix, float)
    xyz = {c: sum((F.lit(float(m[i, j])) * F.col(k) for j, k in enumerate("xyz")), F.lit(0.0)) + F.lit(float(m[i, 3])) for i, c in enumerate("xyz")}
    return points.withColumns(xyz)


def transform_vectors(rows: DataFrame, matrix, columns: tuple[str, str, str] = ("nx", "ny", "nz")) -> DataFrame:
    """Turn vectors by a 4 x 4 matrix, whose shift they ignore."""
    m = np.asarray(matrix, float)
    return rows.withColumns({c: sum((F.lit(float(m[i, j])) * F.col(k) for j, k in enumerate(columns)), F.lit(0.0)) for i, c in enumerate(columns)})


def translation(x: float, y: float, z: float) -> np.ndarray:
    m = np.eye(4)
    m[:3, 3] = x, y, z
    return m


def rotation_z(degrees: float, about=(0.0, 0.0, 0.0)) -> np.ndarray:
    a = np.radians(degrees)
    m = np.eye(4)
    m[:2, :2] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    return translation(*about) @ m @ translation(*[-v for v in about])


def recentre(points: DataFrame) -> tuple[DataFrame, tuple[float, float, float]]:
    """Points moved to the whole metres at their least corner, and that corner."""
    r = points.agg(*[F.floor(F.min(c)).cast("double").alias(c) for c in "xyz"]).first()
    corner = tuple(r[c] or 0.0 for c in "xyz")
    return transform(points, translation(*[-v for v in corner])), corner


def merge(clouds: list[DataFrame]) -> DataFrame:
    """All points with the columns that every cloud has with one type; ``scan_id`` is the cloud's number."""
    common = [c for c, t in clouds[0].dtypes if all((c, t) in d.dtypes for d in clouds[1:])]
    return reduce(lambda a, b: a.unionByName(b), [d.select(*common).withColumn("scan_id", F.lit(i)) for i, d in enumerate(clouds)])


def tiled(points: DataFrame, size: float, origin=(0.0, 0.0), buffer: float = 0.0) -> DataFrame:
    """Points with their tile ``tx, ty``; with a buffer also once for each tile that they lie near.

    ``core`` tells whether the point belongs to the tile itself.
    """
    tx, ty = cell("x", size, origin[0]), cell("y", size, origin[1])
    if not buffer:
        return points.withColumns({"tx": tx, "ty": ty, "core": F.lit(True)})

    def span(c: str, o: float) -> Column:
        return F.explode(F.sequence(F.floor((F.col(c) - o - buffer) / size), F.floor((F.col(c) - o + buffer) / size)))

    held = points.withColumns({"home_x": tx, "home_y": ty}).withColumn("tx", span("x", origin[0])).withColumn("ty", span("y", origin[1]))
    return held.withColumn("core", (F.col("tx") == F.col("home_x")) & (F.col("ty") == F.col("home_y"))).drop("home_x", "home_y")
