"""Rasters as long tables ``row, col, value``; row 0 is the south, no row is no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import around, cell, finite

REDUCERS = {"min": F.min, "max": F.max, "mean": F.avg, "count": F.count}


def rasterize(points: DataFrame, size: float, value: str = "z", reduce: str = "max", origin=(0.0, 0.0)) -> DataFrame:
    """Reduce a column over cells; points that are not finite are ignored."""
    ok = finite("x") & finite("y") & finite(value)
    keyed = points.filter(ok).select(cell("y", size, origin[1]).alias("row"), cell("x", size, origin[0]).alias("col"), value)
    return keyed.groupBy("row", "col").agg(REDUCERS[reduce](value).alias("value"))


def snapped_corner(points: DataFrame, size: float) -> tuple[float, float]:
    r = points.agg(F.floor(F.min("x") / size).alias("x"), F.floor(F.min("y") / size).alias("y")).first()
    return ((r["x"] or 0) * size, (r["y"] or 0) * size)


def along(raster: DataFrame, fixed: str, moving: str, width: int, what: Column) -> Column:
    """An aggregate over the cells up to ``width`` away along one axis, gaps included."""
    return what.over(Window.partitionBy(fixed).orderBy(moving).rangeBetween(-width, width))


def box(raster: DataFrame, width: int, fn) -> DataFrame:
    """A separable aggregate over (2 width + 1) squared cells."""
    one = raster.select("row", "col", along(raster, "row", "col", width, fn("value")).alias("value"))
    return one.select("row", "col", along(one, "col", "row", width, fn("value")).alias("value"))


def opening(raster: DataFrame, width: int) -> DataFrame:
    """Grey opening: the highest of the lowest; cells without data take no part."""
    return box(box(raster, width, F.min), width, F.max)


def smooth(raster: DataFrame, width: int) -> DataFrame:
    """Mean over the square, of the cells that have data."""
    sums = raster.select("row", "col", F.sum("value").over(_line("row", "col", width)).alias("s"), F.count("value").over(_line("row", "col", width)).alias("n"))
    both = sums.select("row", "col", F.sum("s").over(_line("col", "row", width)).alias("s"), F.sum("n").over(_line("col", "row", width)).alias("n"))
    return both.select("row", "col", (F.col("s") / F.col("n")).alias("value"))


def _line(fixed: str, moving: str, width: int):
    return Window.partitionBy(fixed).orderBy(moving).rangeBetween(-width, width)


def neighbours(raster: DataFrame) -> DataFrame:
    """Each cell with ``near``: the values of the 3 x 3 square by place, 4 being its own."""
    spread = raster.select("row", "col", "value").withColumns({"row0": F.col("row"), "col0": F.col("col")})
    spread = around(spread, ["row", "col"])
    place = (F.col("row0") - F.col("row") + 1) * 3 + (F.col("col0") - F.col("col") + 1)
    held = spread.groupBy("row", "col").agg(*[F.max(F.when(place == i, F.col("value"))).alias(f"v{i}") for i in range(9)])
    return held.filter("v4 is not null")


def hillshade(raster: DataFrame, size: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Shade from 0 to 255 by slopes over the eight neighbours; a missing one counts as the cell itself."""
    v = {i: F.coalesce(f"v{i}", "v4") for i in range(9)}
    dx = (v[2] + 2 * v[5] + v[8] - v[0] - 2 * v[3] - v[6]) / F.lit(8.0 * size)
    dy = (v[6] + 2 * v[7] + v[8] - v[0] - 2 * v[1] - v[2]) / F.lit(8.0 * size)
    slope = F.atan(F.sqrt(dx * dx + dy * dy))
    aspect = F.atan2(-dx, -dy)
    alt, az = F.radians(F.lit(altitude)), F.radians(F.lit(azimuth))
    shade = F.sin(alt) * F.cos(slope) + F.cos(alt) * F.sin(slope) * F.cos(az - aspect)
    return neighbours(raster).select("row", "col", (F.greatest(shade, F.lit(0.0)) * 255.0).alias("value"))


def bilinear(points: DataFrame, raster: DataFrame, size: float, origin=(0.0, 0.0), name: str = "ground") -> DataFrame:
    """Points with the value between the four cell centres around them.

    Points beyond the outermost centres take the nearest ones; the value is null
    where one of the four cells has no data.
    """
    u = (F.col("x") - origin[0]) / size - 0.5
    v = (F.col("y") - origin[1]) / size - 0.5
    b = raster.agg(F.min("row"), F.max("row"), F.min("col"), F.max("col")).first()
    if b[0] is None:
        return points.withColumn(name, F.lit(None).cast("double"))
    r0, r1, c0, c1 = (F.lit(x) for x in b)
    p = points.withColumns({"_u": F.least(F.greatest(u, c0.cast("double")), c1.cast("double")), "_v": F.least(F.greatest(v, r0.cast("double")), r1.cast("double"))})
    p = p.withColumns({"_c": F.least(F.floor("_u"), c1 - 1), "_r": F.least(F.floor("_v"), r1 - 1)})
    p = p.withColumns({"_c": F.greatest("_c", c0), "_r": F.greatest("_r", r0)})
    corner = {}
    grid = raster.select(F.col("row").alias("_gr"), F.col("col").alias("_gc"), "value")
    # the four values of a square stand in one row, so that points join once
    square = around(grid.withColumnsRenamed({"_gr": "_r", "_gc": "_c"}).withColumns({"_gr": F.col("_r"), "_gc": F.col("_c")}), ["_r", "_c"]).filter("_gr - _r between 0 and 1 and _gc - _c between 0 and 1")
    for i, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        corner[i] = F.max(F.when((F.col("_gr") - F.col("_r") == dr) & (F.col("_gc") - F.col("_c") == dc), F.col("value"))).alias(f"_q{i}")
    squares = square.groupBy("_r", "_c").agg(*corner.values())
    fx, fy = F.col("_u") - F.col("_c"), F.col("_v") - F.col("_r")

    def weighted(i: int, w: Column) -> Column:
        return F.when(w == 0, 0.0).otherwise(w * F.col(f"_q{i}"))

    value = weighted(0, (1 - fx) * (1 - fy)) + weighted(1, fx * (1 - fy)) + weighted(2, (1 - fx) * fy) + weighted(3, fx * fy)
    return p.join(squares, ["_r", "_c"], "left").withColumn(name, value).select(*points.columns, name)


def local_maxima(raster: DataFrame, size: float, window: float, least: float) -> DataFrame:
    """Cells of ``least`` or more without a higher one in a circle of diameter ``window``.

    Of equal ones the first by column, then row, stands.
    """
    reach = int(window / 2 / size)
    tall = raster.filter(F.col("value") >= least)
    other = around(tall.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("value").alias("value2")).withColumns({"row": F.col("row2"), "col": F.col("col2")}), ["row", "col"], reach)
    d2 = ((F.col("row") - F.col("row2")) ** 2 + (F.col("col") - F.col("col2")) ** 2) * (size * size)
    first = (F.col("col2") < F.col("col")) | ((F.col("col2") == F.col("col")) & (F.col("row2") < F.col("row")))
    beaten = tall.join(other, ["row", "col"]).filter((d2 > 0) & (d2 <= (window / 2) ** 2)).filter((F.col("value2") > F.col("value")) | ((F.col("value2") == F.col("value")) & first))
    return tall.join(beaten.select("row", "col").distinct(), ["row", "col"], "left_anti")


def fill_nearest(raster: DataFrame, rows: range, cols: range, rounds: int | None = None) -> DataFrame:
    """Cells without data take the value of the nearest with data by 4-neighbour steps.

    Each round fills the cells next to those filled; of several neighbours the
    one before in row order gives the value.  Rounds are as many as the widest
    gap needs, each one a join of the open cells only.
    """
    spark = raster.sparkSession
    every = spark.range(rows.start, rows.stop).select(F.col("id").alias("row")).withColumn("col", F.explode(F.sequence(F.lit(cols.start).cast("long"), F.lit(cols.stop - 1).cast("long"))))
    known = raster.filter("value is not null").select("row", "col", "value")
    left = every.join(known, ["row", "col"], "left_anti")
    edge = known
    done = known
    n = 0
    while rounds is None or n < rounds:
        moves = F.array(*[F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in ((1, 0), (0, 1), (0, -1), (-1, 0))])
        step = edge.withColumn("m", F.explode(moves)).select((F.col("row") + F.col("m.r")).alias("row"), (F.col("col") + F.col("m.c")).alias("col"), "value", F.col("row").alias("r0"), F.col("col").alias("c0"))
        edge = step.join(left, ["row", "col"]).groupBy("row", "col").agg(F.min_by("value", F.struct("r0", "c0")).alias("value"))
        from ..plans.scratch import cut

        edge = cut(edge)
        if edge.isEmpty():
            break
        done = done.union(edge)
        left = cut(left.join(edge, ["row", "col"], "left_anti"))
        n += 1
    return done
