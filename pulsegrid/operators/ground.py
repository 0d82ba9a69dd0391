"""Ground: filters, terrain models, heights above ground and canopy height."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.cells import cell
from ..plans.scratch import cut
from . import raster
from .points import tiled


def progressive_morphology(
    points: DataFrame,
    size: float = 0.5,
    max_window: float = 10.0,
    slope: float = 0.3,
    initial: float = 0.15,
    most: float = 2.0,
    origin=(0.0, 0.0),
) -> DataFrame:
    """Points with ``ground``: low against a surface that growing windows have opened.

    All windows run on the raster of lowest points; points meet it once, at the
    end, by their cells.
    """
    surface = raster.rasterize(points, size, reduce="min", origin=origin)
    w = 1
    while (2 * w + 1) * size <= max_window:
        opened = raster.opening(surface, w).withColumnRenamed("value", "opened")
        limit = min(slope * w * size + initial, most)
        high = F.col("value") - F.col("opened") > limit
        surface = cut(surface.join(opened, ["row", "col"]).select("row", "col", F.when(high, F.col("opened")).otherwise(F.col("value")).alias("value")))
        w *= 2
    keyed = points.withColumns({"row": cell("y", size, origin[1]), "col": cell("x", size, origin[0])})
    low = keyed.join(surface, ["row", "col"], "left")
    return low.withColumn("ground", F.coalesce(F.col("z") - F.col("value") <= initial + slope * size, F.lit(False))).select(*points.columns, "ground")


def cloth(cells: pd.DataFrame, rigidness: int, iterations: int, step: float) -> pd.DataFrame:
    """Simulate a cloth that falls on the upturned surface; ``row, col, surface`` to ``row, col, cloth``."""
    r0, c0 = cells["row"].min() - 1, cells["col"].min() - 1
    shape = (cells["row"].max() - r0 + 2, cells["col"].max() - c0 + 2)
    top = np.full(shape, np.nan)
    top[cells["row"] - r0, cells["col"] - c0] = cells["surface"]
    while np.isnan(top).any():  # nearest known value by rings of neighbours
        pad = np.pad(top, 1, constant_values=np.nan)
        near = np.stack([pad[:-2, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:], pad[2:, 1:-1]])
        first = np.argmax(~np.isnan(near), axis=0)
        value = np.take_along_axis(near, first[None], 0)[0]
        top = np.where(np.isnan(top), value, top)
    h = np.full(shape, np.nanmax(top) + 1.0)
    before = h.copy()
    free = np.ones(shape, bool)
    fall = -0.2 * step * step
    links = np.full(shape, 4.0)
    links[[0, -1], :] -= 1
    links[:, [0, -1]] -= 1
    for _ in range(iterations):
        start = h.copy()
        h = np.where(free, h + 0.99 * (h - before) + fall, h)
        before = start
        hit = free & (h <= top)
        h = np.where(hit, top, h)
        free &= ~hit
        for _ in range(rigidness):
            pad = np.pad(h, 1, mode="edge")
            pull = (pad[:-2, 1:-1] + pad[2:, 1:-1] + pad[1:-1, :-2] + pad[1:-1, 2:] - 4 * h) / 4
            h = np.maximum(np.where(free, h + 0.5 * pull, h), top)
        if np.abs(h - start).max() < 1e-4:
            break
    inside = ~np.isnan(h)
    rows, cols = np.nonzero(inside)
    return pd.DataFrame({"row": rows + r0, "col": cols + c0, "cloth": h[inside]})


def cloth_simulation(
    points: DataFrame,
    size: float = 0.5,
    rigidness: int = 2,
    threshold: float = 0.3,
    iterations: int = 500,
    step: float = 0.65,
    tile: float = 100.0,
    buffer: float = 20.0,
) -> DataFrame:
    """Points with ``ground``, by a cloth on each buffered tile of the lowest points' raster.

    Only rasters reach the tiles: points are reduced to cells before, and meet
    the cloth of their own tile's core after, so a tile costs its cells whatever
    the point density is.
    """
    low = raster.rasterize(points, size, reduce="min")
    n, b = int(round(tile / size)), int(round(buffer / size))
    spread = low.withColumnsRenamed({"row": "y", "col": "x", "value": "z"})
    spread = tiled(spread.withColumns({"x": F.col("x") + 0.5, "y": F.col("y") + 0.5}), float(n), buffer=float(b))
    cells = spread.select("tx", "ty", F.floor("y").alias("row"), F.floor("x").alias("col"), "z")

    def fall(pdf: pd.DataFrame) -> pd.DataFrame:
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        # the cloth falls on the surface turned upside down; down and up are exchanged here
        out = cloth(pd.DataFrame({"row": pdf["row"], "col": pdf["col"], "surface": -pdf["z"]}), rigidness, iterations, step)
        own = (out["row"] // n == ty) & (out["col"] // n == tx)
        return pd.DataFrame({"row": out["row"][own], "col": out["col"][own], "value": -out["cloth"][own]})

    sheet = cells.groupBy("tx", "ty").applyInPandas(fall, "row long, col long, value double")
    held = raster.bilinear(points, cut(sheet), size, name="cloth")
    keyed = held.withColumn("ground", F.coalesce(F.abs(F.col("z") - F.col("cloth")) <= threshold, F.lit(False)))
    return keyed.select(*points.columns, "ground")


def terrain(ground: DataFrame, size: float = 0.5, fill: bool = True) -> DataFrame:
    """Lowest ground point of each cell; gaps take the nearest, smoothed over 5 x 5 cells."""
    low = cut(raster.rasterize(ground, size, reduce="min"))
    if not fill:
        return low
    b = low.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if b[0] is None:
        return low
    whole = cut(raster.fill_nearest(low, range(b[0], b[1] + 1), range(b[2], b[3] + 1)))
    mean = raster.smooth(whole, 2).withColumnRenamed("value", "mean")
    known = low.select("row", "col", F.lit(True).alias("known"))
    return whole.join(mean, ["row", "col"]).join(known, ["row", "col"], "left").select("row", "col", F.when(F.col("known"), F.col("value")).otherwise(F.col("mean")).alias("value"))


def heights(points: DataFrame, dtm: DataFrame, size: float) -> DataFrame:
    """Points with ``height`` above the terrain."""
    held = raster.bilinear(points, dtm, size, name="_ground")
    return held.withColumn("height", F.col("z") - F.col("_ground")).drop("_ground")


def canopy_height(points: DataFrame, size: float = 0.5, least: float = 0.0, height: str = "height") -> DataFrame:
    """Highest point of each cell that has any; 0 where nothing reaches ``least``."""
    top = raster.rasterize(points, size, value=height, reduce="max")
    return top.withColumn("value", F.when(F.col("value") >= least, F.col("value")).otherwise(0.0))
