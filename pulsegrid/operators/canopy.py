"""Canopy summaries of point clouds and scans."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell, finite, ratio


def cover(points: DataFrame, size: float, least: float = 2.0) -> DataFrame:
    """Share of the cells with points that have one above ``least``."""
    top = points.filter(finite("z")).groupBy(cell("x", size).alias("cx"), cell("y", size).alias("cy")).agg(F.max("z").alias("top"))
    return top.agg(F.avg(F.when(F.col("top") > least, 1.0).otherwise(0.0)).alias("cover"), F.count("*").alias("cells"))


def vertical_profile(points: DataFrame, layer: float) -> DataFrame:
    """Points and their share of all by layer; the total is carried from the layers' counts."""
    n = points.filter(finite("z")).groupBy(cell("z", layer).alias("layer")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def density_grid(points: DataFrame, size: float) -> DataFrame:
    """Points a cubic metre by voxel, and the share of first returns."""
    first = F.sum(F.when(F.col("return_number") == 1, 1).otherwise(0))
    return points.groupBy(*[cell(c, size).alias(f"i{c}") for c in "xyz"]).agg((F.count("*") / size**3).alias("density"), (first / F.count("*")).alias("first_share"))


def ground_plane(points: DataFrame) -> DataFrame:
    """Least-squares plane ``z = a + b x + c y`` from sums, with its residual deviation."""
    s = points.agg(
        F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"),
        F.var_pop("x").alias("xx"), F.var_pop("y").alias("yy"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("x", "z").alias("xz"), F.covar_pop("y", "z").alias("yz"), F.var_pop("z").alias("zz"),
    )
    det = F.expr("xx * yy - xy * xy")
    s = s.withColumns({"b": ratio(F.expr("xz * yy - yz * xy"), det), "c": ratio(F.expr("yz * xx - xz * xy"), det)})
    return s.select("n", F.expr("mz - b * mx - c * my").alias("a"), "b", "c", F.sqrt(F.greatest(F.expr("zz - b * xz - c * yz"), F.lit(0.0))).alias("sd"))


def fired_pulses(shots: DataFrame, ring: float = 5.0) -> DataFrame:
    """Pulses fired and returned in each ring, and the echoes for each that returned."""
    n = F.size("echoes")
    held = shots.groupBy(cell("zenith", ring).alias("ring")).agg(F.count("*").alias("fired"), F.sum(F.when(n > 0, 1).otherwise(0)).alias("returned"), F.sum(n).alias("echoes"))
    return held.withColumn("per_return", ratio("echoes", "returned"))


def hemisphere(shots: DataFrame, pixels: int = 64, least: float = 1.0) -> DataFrame:
    """A hemispherical picture: pulses and gaps in equal-angle pixels, north up."""
    r = F.col("zenith") / 90.0
    a = F.radians("azimuth")
    half = pixels / 2
    px = F.floor(half + half * r * F.sin(a))
    py = F.floor(half - half * r * F.cos(a))
    gap = ~F.exists("echoes", lambda e: e["height"] > least)
    held = shots.filter(F.col("zenith").between(0, 90)).groupBy(py.alias("row"), px.alias("col")).agg(F.count("*").alias("pulses"), F.sum(F.when(gap, 1).otherwise(0)).alias("gaps"))
    return held.withColumn("value", F.col("gaps") / F.col("pulses"))


def fuse_profiles(profiles: DataFrame, keys: tuple[str, ...] = ("layer",)) -> DataFrame:
    """Mean of profiles ``keys, value, weight`` by their weights."""
    return profiles.groupBy(*keys).agg(ratio(F.sum(F.col("value") * F.col("weight")), F.sum("weight")).alias("value"), F.sum("weight").alias("weight"))


#: Positions up to which each point is held against all of them.
FEW_ORIGINS = 32


def scan_ids(points: DataFrame, origins: DataFrame) -> DataFrame:
    """Points with the ``scan_id`` of the nearest scanner position, of equally near ones the smaller.

    A few positions stand in the expression itself; more of them are met by the
    nearest join, from a radius at which a point sees a position or two.
    """
    o = origins.select("scan_id", "x", "y", "z").limit(FEW_ORIGINS + 1).collect()
    if len(o) > FEW_ORIGINS:
        from .neighbours import nearest

        r = origins.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xyz"]).first()
        start = max(math.sqrt(max(r["x"] * r["y"], r["x"] ** 2, r["y"] ** 2) / r["n"]), r["z"], 1e-3)
        found = nearest(points.select(F.col("pid").alias("id"), "x", "y", "z"), origins.select(F.col("scan_id").alias("pid"), "x", "y", "z"), start, 1e7)
        return points.join(found.select(F.col("id").alias("pid"), F.col("pid").alias("scan_id")), "pid")
    d2 = [(F.col("x") - p["x"]) ** 2 + (F.col("y") - p["y"]) ** 2 + (F.col("z") - p["z"]) ** 2 for p in o]
    each = F.array(*[F.struct(d.alias("d2"), F.lit(p["scan_id"]).alias("scan_id")) for d, p in zip(d2, o, strict=True)])
    return points.withColumn("scan_id", F.array_min(each)["scan_id"])


def plot_summary(trees: DataFrame, area: float) -> DataFrame:
    """Stems a hectare, basal area, mean diameters and dominant height of a plot's trees.

    Dominant height is the mean of the tallest hundred a hectare.
    """
    top = max(1, round(area / 100.0))
    tall = trees.orderBy(F.desc("height"), "tree_id").limit(top).agg(F.avg("height").alias("dominant_height"))
    d = F.col("dbh")
    s = trees.agg(
        (F.count("*") / area * 1e4).alias("stems_ha"),
        (F.sum(math.pi * d * d / 4) / area * 1e4).alias("basal_area"),
        F.avg(d).alias("mean_dbh"),
        F.sqrt(F.avg(d * d)).alias("quadratic_dbh"),
        F.avg("height").alias("mean_height"),
    )
    one = F.lit(1).alias("_k")
    return s.withColumn("_k", one).join(F.broadcast(tall.withColumn("_k", one)), "_k").drop("_k")  # a row each


def tree_increments(pairs: DataFrame, years: float, se: float = 0.005, level: float = 1.96) -> DataFrame:
    """Yearly growth of matched trees, and whether it is beyond what the errors allow."""
    d = F.col("dbh_b") - F.col("dbh_a")
    least = level * math.sqrt(2) * se
    return pairs.withColumns({"dbh_rate": d / years, "height_rate": (F.col("height_b") - F.col("height_a")) / years, "grown": d > least, "shrunk": d < -least})


def tree_states(a: DataFrame, b: DataFrame, matched: DataFrame, damage: float = 0.8) -> DataFrame:
    """State of each tree of two epochs: survivor, damaged, dead or recruit."""
    m = matched.select("id_a", "id_b")
    old = a.select(F.col("id").alias("id_a"), F.col("height").alias("height_a")).join(m, "id_a", "left")
    old = old.join(b.select(F.col("id").alias("id_b"), F.col("height").alias("height_b")), "id_b", "left")
    kind = F.when(F.col("id_b").isNull(), "dead").when(F.col("height_b") < damage * F.col("height_a"), "damaged").otherwise("survivor")
    new = b.select(F.col("id").alias("id_b"), F.col("height").alias("height_b")).join(m, "id_b", "left_anti")
    return old.select("id_a", "id_b", "height_a", "height_b", kind.alias("state")).unionByName(new.select(F.lit(None).cast("long").alias("id_a"), "id_b", F.lit(None).cast("double").alias("height_a"), "height_b", F.lit("recruit").alias("state")))


def survey_shift(a: DataFrame, b: DataFrame, size: float) -> DataFrame:
    """Shift that takes raster b onto a, from height differences and slopes: ``tx, ty, tz``.

    Least squares of ``dz = tz - gx tx - gy ty`` over cells with both rasters and
    both neighbours, from sums alone.
    """
    w = {c: Window.partitionBy(f).orderBy(c) for c, f in (("col", "row"), ("row", "col"))}

    def slope(c: str):
        lo, hi = F.lag("value").over(w[c]), F.lead("value").over(w[c])
        there = (F.lead(c).over(w[c]) - F.lag(c).over(w[c])) == 2
        return F.when(there, (hi - lo) / (2 * size))

    g = a.select("row", "col", F.col("value").alias("za"), slope("col").alias("gx"), slope("row").alias("gy"))
    j = g.join(b.select("row", "col", F.col("value").alias("zb")), ["row", "col"]).filter("gx is not null and gy is not null").withColumn("dz", F.col("za") - F.col("zb"))
    s = j.agg(F.avg("dz").alias("d"), F.avg("gx").alias("mx"), F.avg("gy").alias("my"), F.var_pop("gx").alias("xx"), F.var_pop("gy").alias("yy"), F.covar_pop("gx", "gy").alias("xy"), F.covar_pop("gx", "dz").alias("xd"), F.covar_pop("gy", "dz").alias("yd"), F.count("*").alias("n"))
    det = F.expr("xx * yy - xy * xy")
    s = s.withColumns({"tx": -ratio(F.expr("xd * yy - yd * xy"), det), "ty": -ratio(F.expr("yd * xx - xd * xy"), det)})
    return s.select("n", "tx", "ty", F.expr("d + mx * tx + my * ty").alias("tz"))


def backscatter(echoes: DataFrame, calibration: float) -> DataFrame:
    """Cross section of decomposed echoes: ``calibration * range^4 * amplitude * width``, and its share of the pulse."""
    e = echoes.withColumn("cross_section", calibration * F.pow("range", F.lit(4.0)) * F.col("amplitude") * F.col("width"))
    return e.withColumn("share", F.col("cross_section") / F.sum("cross_section").over(Window.partitionBy("wf_id")))


def leaf_angles(normals: DataFrame, bin: float = 10.0) -> DataFrame:
    """Distribution of leaf inclinations from the normals of leaf points."""
    angle = F.degrees(F.acos(F.least(F.abs("nz"), F.lit(1.0))))
    n = normals.groupBy(F.least(cell(angle, bin), F.lit(int(90 // bin) - 1)).alias("bin")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))


def leaf_or_wood(shapes: DataFrame, linear: float = 0.6, planar: float = 0.75) -> DataFrame:
    """Points of shapes as wood (1) where they are linear or flat and upright, else leaf (0)."""
    wood = (F.col("linearity") >= linear) | ((F.col("planarity") >= planar) & (F.abs("nz") < 0.35))
    return shapes.withColumn("wood", wood.cast("int"))
