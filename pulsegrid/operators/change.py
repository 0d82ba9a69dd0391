"""Change between two epochs, on rasters, voxels and points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import ratio
from ..plans.scratch import cut
from .nearby import Strips, met_in_tiles
from .neighbours import places
from .points import voxels

#: Points of a tile that the cylinders of cores are looked up in.
CLOUD_TILE = 500_000


def difference_of_rasters(a: DataFrame, b: DataFrame, sd_a: float, sd_b: float, factor: float = 1.96) -> DataFrame:
    """b - a on the cells that both have, with the level of detection."""
    lod = factor * (sd_a * sd_a + sd_b * sd_b) ** 0.5
    both = a.select("row", "col", F.col("value").alias("value_a")).join(b.select("row", "col", F.col("value").alias("value_b")), ["row", "col"])
    return both.withColumn("diff", F.col("value_b") - F.col("value_a")).withColumn("significant", F.abs("diff") > lod)


def occupancy(points: DataFrame, beams: DataFrame, size: float) -> DataFrame:
    """Hits and beams by voxel; a voxel that either has stands once."""
    h = voxels(points, size).groupBy("ix", "iy", "iz").agg(F.count("*").alias("hits"))
    both = h.join(beams, ["ix", "iy", "iz"], "full_outer")
    return both.select("ix", "iy", "iz", F.coalesce("hits", F.lit(0)).alias("hits"), F.greatest(F.coalesce("beams", F.lit(0)), F.coalesce("hits", F.lit(0))).alias("beams"))


def occupancy_change(a: DataFrame, b: DataFrame, min_hits: int = 1, min_pulses: int = 3, alpha: float = 0.05) -> DataFrame:
    """Classes by voxel: 0 unknown, 1 empty, 2 occupied in both, 3 lost, 4 gained.

    Lost or gained needs that the emptiness is no chance: with p the hit share
    where it is occupied and n the beams where it is empty, (1 - p)^n <= alpha.
    """
    key = ["ix", "iy", "iz"]
    zero = F.lit(0).cast("long")
    j = a.select(*key, F.col("hits").alias("ha"), F.col("beams").alias("na")).join(b.select(*key, F.col("hits").alias("hb"), F.col("beams").alias("nb")), key, "full_outer").na.fill(0, ["ha", "na", "hb", "nb"])
    occ = {e: F.col(f"h{e}") >= min_hits for e in "ab"}
    free = {e: (F.col(f"h{e}") == zero) & (F.col(f"n{e}") >= min_pulses) for e in "ab"}

    def sure(full: str, empty: str) -> Column:
        p = F.least(ratio(f"h{full}", f"n{full}"), F.lit(1.0))
        return F.pow(1 - p, F.col(f"n{empty}")) <= alpha

    kind = (
        F.when(occ["a"] & occ["b"], 2)
        .when(occ["a"] & free["b"] & sure("a", "b"), 3)
        .when(free["a"] & occ["b"] & sure("b", "a"), 4)
        .when(free["a"] & free["b"], 1)
        .otherwise(0)
    )
    return j.select(*key, "ha", "na", "hb", "nb", kind.alias("class"))


def m3c2(cores: DataFrame, a: DataFrame, b: DataFrame, radius: float, depth: float, registration: float = 0.0, least: int = 4) -> DataFrame:
    """Distance along each core point's normal between the means of two clouds in a cylinder.

    ``cores(id, x, y, z, nx, ny, nz)``; a cylinder with no points of one cloud
    gives null, and too few points give no level of detection.  Tasks look up the
    points of a tile's cylinders and hand on their number, mean and spread, so that
    no pair moves; cores of one place and normal are looked up once.
    """
    axes = ("x", "y", "z", "nx", "ny", "nz")
    shared = places(cores, axes)
    spots = cores if shared is None else shared[0]
    reach = [(F.abs(f"n{c}") * depth + F.sqrt(F.greatest(1 - F.col(f"n{c}") * F.col(f"n{c}"), F.lit(0.0))) * radius) * (1 + 1e-6) + F.abs(c) * 1e-12 for c in "xy"]
    known = sum((F.col(c) * 0 for c in axes), F.lit(0.0)) == 0
    boxes = cut(spots.filter(known).select("id", *axes, *[(F.col(c) + sign * r).alias(f"{c}{k}") for c, r in zip("xy", reach, strict=True) for k, sign in enumerate((-1, 1))]))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left) and len(right):
            x, y, z = (left[c].to_numpy("f8") for c in "xyz")
            strips = Strips(x, y, float((right["x1"] - right["x0"]).mean()) / 8)
            x, y, z = (v[strips.order] for v in (x, y, z))
            for i, px, py, pz, nx, ny, nz, x0, x1, y0, y1 in zip(*(right[c].tolist() for c in ("id", *axes, "x0", "x1", "y0", "y1")), strict=True):
                some = strips.box(x0, x1, y0, y1)
                dx, dy, dz = x[some] - px, y[some] - py, z[some] - pz
                along = dx * nx + dy * ny + dz * nz
                # the way off the axis by the cross product: d2 - s * s would lose the digits that decide on the rim
                u, v, w = dy * nz - dz * ny, dz * nx - dx * nz, dx * ny - dy * nx
                along = along[(np.abs(along) <= depth) & (u * u + v * v + w * w <= radius * radius)]
                if len(along):
                    rows.append((i, len(along), along.mean(), along.var() * len(along)))
        return pd.DataFrame(rows, columns=["id", "n", "mean", "m2"])

    def side(cloud: DataFrame, name: str) -> DataFrame:
        parts = met_in_tiles(cloud.select(*[F.col(c).cast("double").alias(c) for c in "xyz"]), boxes, run, "id long, n long, mean double, m2 double", CLOUD_TILE)
        n, total = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
        spread = F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - total * total / n
        return parts.groupBy("id").agg((total / n).alias(f"m{name}"), F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / (n - 1))).alias(f"s{name}"), n.alias(f"n{name}"))

    j = spots.select("id").join(side(a, "a"), "id", "left").join(side(b, "b"), "id", "left")
    if shared is not None:
        j = shared[1].join(j.withColumnRenamed("id", "place"), "place").drop("place")
    j = j.na.fill(0, ["na", "nb"])
    d = F.col("mb") - F.col("ma")
    enough = (F.col("na") >= max(least, 2)) & (F.col("nb") >= max(least, 2))
    lod = F.when(enough, 1.96 * (F.sqrt(F.col("sa") * F.col("sa") / F.col("na") + F.col("sb") * F.col("sb") / F.col("nb")) + registration))
    return j.select("id", d.alias("distance"), lod.alias("lod"), "na", "nb", F.coalesce(F.abs(d) > lod, F.lit(False)).alias("significant"))


def gap_change(a: DataFrame, b: DataFrame, height: float = 2.0) -> DataFrame:
    """Cells by gap state in two canopy rasters, over the cells of both."""
    j = a.select("row", "col", F.col("value").alias("va")).join(b.select("row", "col", F.col("value").alias("vb")), ["row", "col"])
    ga, gb = F.col("va") <= height, F.col("vb") <= height
    kind = F.when(ga & gb, "persistent").when(ga, "closed").when(gb, "opened").otherwise("canopy")
    return j.groupBy(kind.alias("state")).agg(F.count("*").alias("cells"), F.avg(F.col("vb") - F.col("va")).alias("mean_change"))
