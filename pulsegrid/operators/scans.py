"""Scans of one place: scores of a registration, stem maps without a first guess, targets, and the flight line."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell, ratio
from ..plans.scratch import cut
from .fit import ASKED, closest_in_task, corners_of, icp_tiles, moved_by, paired, unpacked
from .graph import clusters
from .neighbours import knn, places, radius_join
from .points import merge, tiled, transform
from .poses import se3_exp
from .trees import circle_fit_at

XYZ = ("x", "y", "z")


# --- scores and information of a registration --------------------------------


def closest(source: DataFrame, target: DataFrame, matrix, reach: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """Moved source points ``id, px, py, pz`` with the nearest target ``pid, x, y, z`` within reach, ``d2`` and ``keep``; others are left out.

    The search widens to ``reach`` only where nothing is nearer, so that pairs
    follow the points and not their density.
    """
    moved = transform(source.select(F.col("pid").alias("id"), *XYZ), matrix)
    near = knn(moved, target, 1, reach, reach, 3, keep=(*XYZ, *keep)).drop("rank")
    held = ["px", "py", "pz", "pid", *XYZ, "d2", *keep]
    met = near.join(moved.select("id", *[F.col(c).alias(f"p{c}") for c in XYZ]), "id")
    # of an id that stands more than once the place that was nearest
    off = F.abs(sum(((F.col(c) - F.col(f"p{c}")) * (F.col(c) - F.col(f"p{c}")) for c in XYZ), F.lit(0.0)) - F.col("d2"))
    best = met.groupBy("id").agg(F.min_by(F.struct(*held), F.struct(off, "d2", "pid")).alias("m"))
    return best.select("id", *[f"m.{c}" for c in held])


def once(source: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points whose pid stands once, and those of the others."""
    twice = cut(source.groupBy("pid").agg(F.count("*").alias("n")).filter("n > 1").select("pid"))
    if twice.isEmpty():
        return source, source.limit(0)
    return source.join(twice, "pid", "left_anti"), source.join(twice, "pid", "left_semi")


def evaluate_registration(source: DataFrame, target: DataFrame, matrix, threshold: float = 0.1) -> DataFrame:
    """``fitness, inlier_rmse, n_inliers``: the share of source points with a target point within the threshold, and their distance.

    Tiles pair the points and hand on sums; only a pid that stands more than once is paired by itself.
    """
    m = np.asarray(matrix, float)
    alone, others = once(source)
    sums = paired(icp_tiles(alone, target, m, threshold), m, threshold, np.zeros(3), True).select("n", "sd")
    if not others.isEmpty():
        sums = sums.union(closest(others, target, matrix, threshold).agg(F.count("*").cast("double"), F.sum("d2")))
    hits = sums.agg(F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("n_inliers"), F.sum("sd").alias("sd"))
    whole = source.agg(F.count("*").alias("n"))
    rmse = F.when(F.col("n_inliers") > 0, F.sqrt(F.col("sd") / F.col("n_inliers")))
    return hits.join(F.broadcast(whole)).select(F.coalesce(ratio("n_inliers", "n"), F.lit(0.0)).alias("fitness"), rmse.alias("inlier_rmse"), "n_inliers")


NORMAL = ("nx", "ny", "nz")
#: Sums of the point-to-plane equations.
PLANE_SUMS = ("n", "rr", *[f"h{a}{b}" for a in range(6) for b in range(a, 6)], *[f"g{a}" for a in range(6)])


def plane_paired(tiles: DataFrame, m: np.ndarray, reach: float, scale: float) -> DataFrame:
    """``plane_sums`` from the tiles of ``icp_tiles``, whose targets have normals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in unpacked(batches):
            q, p = (np.column_stack([row[f"{k}{c}"] for c in XYZ]) for k in "st")
            normal, many = np.column_stack([row[c] for c in NORMAL]), row["n"]
            ask, upper = closest_in_task(p, row["pid"], reach), np.triu_indices(6)
            total = np.zeros(len(PLANE_SUMS))
            for a in range(0, len(q), ASKED):
                moved = q[a : a + ASKED] @ m[:3, :3].T + m[:3, 3]
                which, _ = ask(moved)
                ok = which >= 0
                u, v, w = moved[ok], normal[which[ok]], many[a : a + ASKED][ok].astype(float)
                r = (v * (u - p[which[ok]])).sum(axis=1)
                total[0] += w.sum()
                good = np.isfinite(r)  # a target without a normal has no plane
                u, v, w, r = u[good], v[good], w[good], r[good]
                total[1] += w @ (r * r)
                if math.isfinite(scale):
                    w = w * np.where(np.abs(r) > scale, scale / np.maximum(np.abs(r), 1e-300), 1.0)
                j = np.column_stack([v, np.cross(u, v)])
                total[2:] += np.concatenate([((j * w[:, None]).T @ j)[upper], j.T @ (w * r)])
            yield pa.RecordBatch.from_arrays([pa.array([float(v)]) for v in total], names=list(PLANE_SUMS))

    sums = tiles.mapInArrow(run, ", ".join(f"{c} double" for c in PLANE_SUMS)).agg(*[F.sum(c).alias(c) for c in PLANE_SUMS])
    return sums.select(F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), F.sqrt(F.col("rr") / F.col("n")).alias("rmse"), *PLANE_SUMS[2:])


def plane_sums(source: DataFrame, target: DataFrame, matrix, reach: float, scale: float = math.inf) -> DataFrame:
    """Sums of the point-to-plane normal equations at a pose: ``n, rmse, h00 .. h55, g0 .. g5``.

    ``target`` has unit normals ``nx, ny, nz``.  The unknown is a twist
    (shift, then turn) applied after ``matrix``; residuals beyond ``scale`` weigh
    by it over their size.
    """
    m = np.asarray(matrix, float)
    return plane_paired(icp_tiles(source, target, m, reach, NORMAL), m, reach, scale)


def plane_icp(source: DataFrame, target: DataFrame, reach: float, rounds: int = 30, tolerance: float = 1e-7, scale: float = math.inf, start=None) -> tuple[np.ndarray, float, int]:
    """Iterative closest points on the target's planes: transform, residual and rounds.

    Spark sums 27 numbers a round; the driver solves for six unknowns.  Both sides are
    dealt to tiles once, and again only when points have moved by more than the reach.
    """
    m = np.eye(4) if start is None else np.asarray(start, float)
    corners, tiles, dealt = corners_of(source), None, m
    rmse, n = math.nan, 0
    for n in range(1, rounds + 1):
        if tiles is None or not moved_by(corners, m, dealt) <= reach * (1 - 1e-6):
            tiles, dealt = cut(icp_tiles(source, target, m, 2 * reach, NORMAL)), m
        s = plane_paired(tiles, m, reach, scale).first()
        if s["n"] < 6:
            raise ValueError("too few pairs within reach")
        h = np.array([[s[f"h{min(a, b)}{max(a, b)}"] for b in range(6)] for a in range(6)])
        step = -np.linalg.lstsq(h, np.array([s[f"g{a}"] for a in range(6)]), rcond=1e-12)[0]
        m, rmse = se3_exp(step) @ m, s["rmse"]
        if np.abs(step).max() < tolerance:
            break
    return m, rmse, n


# --- stem maps ----------------------------------------------------------------

#: Cells of turns in a full circle, for votes.
TURNS = 180
STEMS = ("id", "x", "y", "z", "dbh")
#: Pairs of stems, and of pairs, that are tried at first; more follow where these do not settle a pose.
FIRST_PAIRS, FIRST_MEETINGS = 1_000_000, 4_000_000


def stem_pairs(stems: DataFrame, near: float, far: float) -> DataFrame:
    """Ordered pairs of stems of one map, by their distance, their direction and both diameters."""
    q = stems.select(F.col("id").alias("i"), "x", "y", F.col("x").alias("xi"), F.col("y").alias("yi"), F.col("dbh").alias("di"))
    p = stems.select(F.col("id").alias("pid"), "x", "y", F.col("dbh").alias("dj"))
    both = radius_join(q, p, far, 2, keep=("i", "xi", "yi", "di")).filter(F.col("d2") >= near * near)
    turn = F.atan2(F.col("y") - F.col("yi"), F.col("x") - F.col("xi"))
    return both.select("i", F.col("pid").alias("j"), F.sqrt("d2").alias("gap"), turn.alias("turn"), ((F.col("x") + F.col("xi")) / 2).alias("mx"), ((F.col("y") + F.col("yi")) / 2).alias("my"), "di", "dj")


def spread(value: str, tolerance: float) -> Column:
    """The cells, twice as wide as the tolerance, that a value within it may stand in."""
    w = 2 * tolerance
    return F.explode(F.sequence(F.floor((F.col(value) - tolerance) / w), F.floor((F.col(value) + tolerance) / w)))


def votes(a: DataFrame, b: DataFrame, tolerance: float, dbh_tolerance: float, near: float, far: float, most: float = math.inf) -> tuple[DataFrame, bool]:
    """Poses ``yaw, tx, ty`` that like pairs of two maps propose, by the number of pairs that propose them, and whether all pairs met.

    Pairs meet in cells of separation and of both diameters, so a pair sees
    only pairs like it.  Cells with fewest meetings come first; those with which there would
    be more than ``most`` in all stay away.  Poses are counted in two grids, half a cell apart.
    """
    keys = ["cg", "cd", "ce"]
    pa = stem_pairs(a, near, far).withColumns({"cg": cell("gap", 2 * tolerance), "cd": cell("di", 2 * dbh_tolerance), "ce": cell("dj", 2 * dbh_tolerance)}).filter("i < j")
    pb = stem_pairs(b, near, far).toDF("i2", "j2", "gap2", "turn2", "mx2", "my2", "di2", "dj2")
    pb = pb.withColumn("cg", spread("gap2", tolerance)).withColumn("cd", spread("di2", dbh_tolerance)).withColumn("ce", spread("dj2", dbh_tolerance))
    pa, pb, whole = cut(pa), cut(pb), True
    each = pa.groupBy(*keys).agg(F.count("*").cast("double").alias("na")).join(pb.groupBy(*keys).agg(F.count("*").alias("nb")), keys)
    each = cut(each.select(*keys, F.floor(F.log2(F.col("na") * F.col("nb"))).alias("size"), (F.col("na") * F.col("nb")).alias("n")))
    sizes = each.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").collect()
    held = np.cumsum([r["n"] for r in sizes])
    if len(sizes) and held[-1] > most:
        whole = False
        pa = pa.join(each.filter(F.col("size") <= sizes[max(int((held <= most).sum()) - 1, 0)]["size"]).select(*keys), keys, "left_semi")
    like = (F.abs(F.col("gap") - F.col("gap2")) <= tolerance) & (F.abs(F.col("di") - F.col("di2")) <= dbh_tolerance) & (F.abs(F.col("dj") - F.col("dj2")) <= dbh_tolerance)
    met = pa.join(pb, keys).filter(like).withColumn("yaw", F.col("turn2") - F.col("turn"))
    s, c = F.sin("yaw"), F.cos("yaw")
    poses = met.select("yaw", (F.col("mx2") - c * F.col("mx") + s * F.col("my")).alias("tx"), (F.col("my2") - s * F.col("mx") - c * F.col("my")).alias("ty"))
    width, turn = 4 * tolerance, 2 * math.pi / TURNS
    grids = [
        F.struct(F.lit(k).alias("grid"), F.pmod(F.floor(F.col("yaw") / turn + k / 2), F.lit(TURNS)).alias("cy"), F.floor(F.col("tx") / width + k / 2).alias("cx"), F.floor(F.col("ty") / width + k / 2).alias("ct"))
        for k in (0, 1)
    ]
    held = poses.withColumn("at", F.explode(F.array(*grids))).groupBy("at").agg(F.count("*").alias("n"), F.avg(F.sin("yaw")).alias("s"), F.avg(F.cos("yaw")).alias("c"), F.avg("tx").alias("tx"), F.avg("ty").alias("ty"))
    return held.select("n", F.atan2("s", "c").alias("yaw"), "tx", "ty"), whole


def stem_links(a: DataFrame, b: DataFrame, poses: list[tuple[int, float, float, float]], tolerance: float, dbh_tolerance: float) -> DataFrame:
    """``pose, id_a, id_b, d2`` and both places: stems that are each other's nearest under a pose ``(number, yaw, tx, ty)``."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("pose"), *[F.lit(float(v)).alias(n) for n, v in zip(("yaw", "tx", "ty"), p, strict=True)]) for k, *p in poses]))
    q = a.select("id", *[F.col(c).alias(f"a{c}") for c in STEMS[1:]], each.alias("t")).select("*", "t.*").drop("t")
    q = q.withColumns({"x": F.expr("cos(yaw) * ax - sin(yaw) * ay + tx"), "y": F.expr("sin(yaw) * ax + cos(yaw) * ay + ty")})
    held = ("pose", "id", "ax", "ay", "az", "adbh")
    p = b.select(F.col("id").alias("id_b"), "x", "y", F.col("z").alias("bz"), F.col("dbh").alias("bdbh"))
    near = radius_join(q, p, tolerance, 2, keep=held).withColumn("off", F.abs(F.col("adbh") - F.col("bdbh"))).filter(F.col("off") <= dbh_tolerance)
    first = near.withColumn("ra", F.row_number().over(Window.partitionBy("pose", "id").orderBy("d2", "off", "id_b"))).filter("ra = 1")
    mutual = near.groupBy("pose", "id_b").agg(F.min_by("id", F.struct("d2", "off", "id")).alias("id"))
    return first.join(mutual, ["pose", "id_b", "id"]).select("pose", F.col("id").alias("id_a"), "id_b", "d2", "ax", "ay", "az", F.col("x").alias("bx"), F.col("y").alias("by"), "bz")


def stems_of(links: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """``id_a, id_b, distance`` of all stems ``id, least`` that stand for each other: of one id first, the others of a place by their order."""
    one = links.select(F.col("id_a").alias("ga"), F.col("id_b").alias("gb"), F.sqrt("d2").alias("distance"))
    left = cut(one.join(a.select(F.col("id").alias("id_a"), F.col("least").alias("ga")), "ga"))
    right = cut(one.select("ga", "gb").join(b.select(F.col("id").alias("id_b"), F.col("least").alias("gb")), "gb").select("ga", "id_b"))
    same = cut(left.join(right, (left["ga"] == right["ga"]) & (left["id_a"] == right["id_b"])).select(left["ga"], "id_a", "id_b", "distance"))
    w = Window.partitionBy("ga")
    rest = [side.join(same.select("ga", k), ["ga", k], "left_anti").withColumn("nth", F.row_number().over(w.orderBy(k))) for side, k in ((left, "id_a"), (right, "id_b"))]
    return same.drop("ga").union(rest[0].join(rest[1], ["ga", "nth"]).select("id_a", "id_b", "distance"))


def match_stem_maps(a: DataFrame, b: DataFrame, tolerance: float = 0.15, dbh_tolerance: float = 0.05, near: float = 1.0, far: float = 15.0, least: int = 4, poses: int = 16, rounds: int = 5) -> tuple[np.ndarray | None, DataFrame]:
    """Turn and shift that take stem map a onto b without a first guess, and the matched stems ``id_a, id_b, distance``.

    Maps have ``id, x, y, z, dbh``; a stem without a diameter takes no part.
    Pairs of stems between ``near`` and ``far`` apart propose poses, the ``poses``
    with most votes are tried on all stems, and the one under which most stems
    meet is refined.  No pose (None) if fewer than ``least`` meet.

    All pairs of a dense map are far more than its stems, and meetings of pairs grow
    with their square.  So near pairs and rare ones propose first, about as many as stems; if
    under no pose half of the smaller map meets, four times as many stand up, up to all of them.
    Stems of one place and diameter find the pose as one, by the least id; then each
    of them has its partner, that of its own id if there is one, else by their order.
    """
    ok = " and ".join(f"{c} is not null" for c in STEMS)
    one = [F.min("id").alias("id"), F.min_by("z", "id").alias("z")]
    every = [cut(m.select(*STEMS).filter(ok)) for m in (a, b)]
    a, b = (cut(m.groupBy("x", "y", "dbh").agg(*one).select(*STEMS)) for m in every)
    named = [m.select("id", "x", "y", "dbh").join(g.select(F.col("id").alias("least"), "x", "y", "dbh"), ["x", "y", "dbh"]).select("id", "least").distinct() for m, g in zip(every, (a, b), strict=True)]
    none = a.sparkSession.createDataFrame([], "id_a long, id_b long, distance double")
    mid = a.agg(F.avg("x").alias("x"), F.avg("y").alias("y")).first()
    if mid["x"] is None:
        return None, none
    centred = a.withColumns({c: F.col(c) - F.lit(mid[c]) for c in "xy"})
    sides = [m.agg(F.count("*").alias("n"), *[(F.max(c) - F.min(c)).alias(c) for c in "xy"]).first() for m in (a, b)]
    dense = max(r["n"] / max(r["x"] * r["y"], 1.0) for r in sides) if sides[1]["n"] else 1.0
    fewer, stems = min(r["n"] for r in sides), max(r["n"] for r in sides)
    beside, meetings = max(16.0, FIRST_PAIRS / stems), max(FIRST_MEETINGS, 200.0 * stems)
    while True:
        wide = min(far, math.sqrt(near * near + beside / (math.pi * dense)))
        proposed, whole = votes(centred, b, tolerance, dbh_tolerance, near, wide, meetings)
        top = proposed.orderBy(F.desc("n"), "yaw", "tx", "ty").limit(poses).collect()
        score = None
        if top:
            tried = stem_links(centred, b, [(k, r["yaw"], r["tx"], r["ty"]) for k, r in enumerate(top)], 2 * tolerance, dbh_tolerance)
            score = tried.groupBy("pose").agg(F.count("*").alias("n"), F.sum("d2").alias("d2")).orderBy(F.desc("n"), "d2", "pose").first()
        if whole and wide >= far or score is not None and score["n"] >= least and 2 * score["n"] >= fewer:
            break
        beside, meetings = 4 * beside, 16 * meetings
    if score is None or score["n"] < least:
        return None, none
    best = top[score["pose"]]
    yaw, tx, ty, tz = best["yaw"], best["tx"], best["ty"], 0.0
    links, met = none, None
    for k in range(rounds):
        links = cut(stem_links(centred, b, [(0, yaw, tx, ty)], tolerance * (2 if k == 0 else 1), dbh_tolerance))
        s = links.agg(
            F.count("*").alias("n"), F.sum("d2").alias("d2"), *[F.avg(c).alias(c) for c in ("ax", "ay", "az", "bx", "by", "bz")],
            *[F.covar_pop(f"a{p}", f"b{q}").alias(p + q) for p in "xy" for q in "xy"],
        ).first()
        if s["n"] < least:
            return None, none
        if met == (s["n"], s["d2"]):
            break
        met = (s["n"], s["d2"])
        yaw = math.atan2(s["xy"] - s["yx"], s["xx"] + s["yy"])
        tx = s["bx"] - math.cos(yaw) * s["ax"] + math.sin(yaw) * s["ay"]
        ty = s["by"] - math.sin(yaw) * s["ax"] - math.cos(yaw) * s["ay"]
        tz = s["bz"] - s["az"]
    m = np.eye(4)
    m[:2, :2] = [[math.cos(yaw), -math.sin(yaw)], [math.sin(yaw), math.cos(yaw)]]
    m[:3, 3] = np.array([tx, ty, tz]) - m[:3, :3] @ np.array([mid["x"], mid["y"], 0.0])
    return m, stems_of(links, *named)


# --- targets, stems as gauges, views ------------------------------------------


def detect_reflectors(points: DataFrame, value: str, bright: float, radius: float = 0.15, least: int = 8, widest: float = 0.5) -> DataFrame:
    """Targets by their return strength: ``target, x, y, z, value, diameter, n``.

    Bright returns are clustered; a cluster of ``least`` returns and no wider
    than ``widest`` along any axis is a target, at its mean weighted by how far
    each return outshines the cluster's faintest.
    """
    lit = cut(points.filter(F.col(value) >= bright).select("pid", *XYZ, F.col(value).cast("double").alias("v")))
    held = lit.join(clusters(lit, radius, least).filter("cluster >= 0").distinct(), "pid")
    faint = held.groupBy("cluster").agg(F.min("v").alias("v0"))
    w = F.col("v") - F.col("v0") + 1
    span = {c: F.max(c) - F.min(c) for c in XYZ}
    out = held.join(faint, "cluster").groupBy(F.col("cluster").alias("target")).agg(
        *[(F.sum(F.col(c) * w) / F.sum(w)).alias(c) for c in XYZ], F.percentile("v", F.lit(0.5)).alias("value"),
        F.sqrt(span["x"] * span["x"] + span["y"] * span["y"]).alias("diameter"), F.count("*").alias("n"), F.greatest(*span.values()).alias("wide"),
    )
    return out.filter(F.col("wide") <= widest).drop("wide")


def stem_noise(points: DataFrame, stems: DataFrame, low: float = 1.0, high: float = 3.0, step: float = 0.25, thickness: float = 0.1, search: float = 1.0, cut_least: float = 0.05, cut_share: float = 0.3, height: str = "z") -> DataFrame:
    """Noise of a cloud from round stems: ``stem, slice, n, radius, rms, mad, arc`` of thin slices of stems ``stem, x, y``.

    Residuals are distances from the slice's circle; those beyond the larger of
    ``cut_least`` and ``cut_share`` of the radius are not stem.  ``arc`` counts
    the degrees, in steps of ten, from which the stem is seen.
    """
    k = F.floor(F.col(height) / step + 0.5)
    thin = points.withColumn("slice", k).filter((F.abs(F.col(height) - F.col("slice") * step) <= thickness / 2) & F.col(height).between(low, high))
    thin = thin.select("x", "y", "slice")
    shared = places(stems, ("x", "y"), "stem")
    spots = stems if shared is None else shared[0]
    at = spots.select("stem", "x", "y", F.col("x").alias("sx"), F.col("y").alias("sy"))
    fits = circle_fit_at(radius_join(at, thin, search, 2, keep=("stem", "sx", "sy")), ["stem", "slice"], "sx", "sy").filter("radius is not null")
    # the slices of stems meet their points again, so that pairs are not moved to their circles
    fits = cut(fits.select("stem", "slice", F.col("x").alias("cx"), F.col("y").alias("cy"), "radius"))
    again = at.join(fits, "stem")
    rest = radius_join(again, thin, search, 2, keep=("stem", "cx", "cy", "radius"), on=("slice",)).withColumn("r", F.expr("sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - radius"))
    rest = rest.filter(F.abs("r") <= F.greatest(F.lit(float(cut_least)), cut_share * F.col("radius")))
    # sectors of ten degrees, 36 of them and due west apart, as bits
    sector = F.floor(F.degrees(F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx"))) / 10) + 18
    out = rest.withColumn("sector", sector.cast("int")).select("stem", "slice", "radius", "r", F.expr("shiftleft(1L, sector)").alias("seen"))
    out = out.groupBy("stem", "slice", "radius").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"), F.percentile(F.abs("r"), F.lit(0.5)).alias("mad"), (F.bit_count(F.bit_or("seen")).cast("long") * 10).alias("arc")
    )
    if shared is not None:
        out = out.withColumnRenamed("stem", "place").join(shared[1], "place")
    return out.select("stem", "slice", "n", "radius", "rms", "mad", "arc")


def hemisphere_from_points(points: DataFrame, origin=(0.0, 0.0, 0.0), pixels: int = 64, widest: float = 90.0, reach: float | None = None) -> DataFrame:
    """A picture of a cloud from a viewpoint: ``row, col, points, near`` of the pixels that points cover; the rest of the sky is a gap.

    Equal angles from the zenith, north up; ``near`` is the least distance.
    """
    d = {f"d{c}": F.col(c) - F.lit(float(o)) for c, o in zip(XYZ, origin, strict=True)}
    seen = points.select(*[c.alias(k) for k, c in d.items()]).withColumns({"flat": F.expr("sqrt(dx * dx + dy * dy)"), "range": F.expr("sqrt(dx * dx + dy * dy + dz * dz)")})
    seen = seen.withColumn("zenith", F.degrees(F.atan2("flat", "dz"))).filter((F.col("range") > 0) & (F.col("zenith") <= widest))
    if reach is not None:
        seen = seen.filter(F.col("range") <= reach)
    half = pixels / 2
    r = half * F.col("zenith") / widest
    row = F.least(F.floor(half - r * F.when(F.col("flat") > 0, F.col("dy") / F.col("flat")).otherwise(0.0)), F.lit(pixels - 1))
    col = F.least(F.floor(half + r * F.when(F.col("flat") > 0, F.col("dx") / F.col("flat")).otherwise(0.0)), F.lit(pixels - 1))
    return seen.groupBy(row.alias("row"), col.alias("col")).agg(F.count("*").alias("points"), F.min("range").alias("near"))


def fired_from_returns(pulses: DataFrame, ring: float = 5.0, ground: tuple[float, float] = (100.0, 125.0), tail: float = 1e-5, view: float | None = 100.0) -> DataFrame:
    """``ring, fired``: pulses fired into each zenith ring, from pulses that returned (a row with ``zenith`` for each).

    Downward pulses nearly all return, so their number for a degree between the
    ``ground`` zeniths is the rate everywhere; a ring gets it for the part of its
    width inside the scan's limits.  The lower limit is an upper quantile of the
    zeniths, the upper one stands ``view`` degrees above it, or is read from the
    returns too.
    """
    low, high = ground
    counts = pulses.groupBy("zenith").agg(F.count("*").alias("n"))
    s = counts.agg(
        F.percentile("zenith", F.lit(1 - tail), F.col("n")).alias("last"), F.percentile("zenith", F.lit(tail), F.col("n")).alias("first"), F.sum(F.when(F.col("zenith").between(low, high), F.col("n")).otherwise(0)).alias("hits")
    )
    first = F.col("first") if view is None else F.greatest(F.col("last") - view, F.lit(0.0))
    s = s.select((F.col("hits") / (high - low)).alias("rate"), first.alias("first"), "last")
    rings = s.withColumn("ring", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(math.ceil(180 / ring) - 1).cast("long"))))
    width = F.least((F.col("ring") + 1) * ring, F.col("last")) - F.greatest(F.col("ring") * ring, F.col("first"))
    return rings.select("ring", (F.col("rate") * F.greatest(width, F.lit(0.0))).alias("fired"))


def tiles_from_scans(scans: list[DataFrame], tile: float, voxel: float, transforms=None, bounds: tuple[float, float, float, float] | None = None, origin=(0.0, 0.0, 0.0)) -> DataFrame:
    """Scans, moved and cut to bounds, as one cloud with ``scan_id, tx, ty``: the first point of each voxel in scan order, then by pid."""
    moves = transforms or [None] * len(scans)
    cloud = merge([s if m is None else transform(s, m) for s, m in zip(scans, moves, strict=True)])
    if bounds is not None:
        cloud = cloud.filter(F.col("x").between(bounds[0], bounds[2]) & F.col("y").between(bounds[1], bounds[3]))
    keys = [cell(c, voxel, o).alias(f"v{c}") for c, o in zip(XYZ, origin, strict=True)]
    kept = cloud.groupBy(*keys).agg(F.min_by(F.struct(*cloud.columns), F.struct("scan_id", "pid")).alias("p")).select("p.*")
    return tiled(kept, tile, origin[:2]).drop("core")


# --- flight line ----------------------------------------------------------------


def pulse_lines(returns: DataFrame, separation: float = 2.0) -> DataFrame:
    """Lines through the scanner: ``line, t``, the first return ``fx, fy, fz`` and the unit way ``ux, uy, uz`` up to it from the last.

    ``returns(line, t, rank, x, y, z)``: those of one line and time are a pulse.
    """
    p = F.struct(*XYZ)
    ends = returns.groupBy("line", "t").agg(F.min_by(p, F.struct("rank", *XYZ)).alias("f"), F.max_by(p, F.struct("rank", *XYZ)).alias("l"))
    way = {f"u{c}": F.col(f"f.{c}") - F.col(f"l.{c}") for c in XYZ}
    got = ends.select("line", "t", *[F.col(f"f.{c}").alias(f"f{c}") for c in XYZ], *[c.alias(k) for k, c in way.items()]).withColumn("gap", F.expr("sqrt(ux * ux + uy * uy + uz * uz)"))
    return got.filter(F.col("gap") >= separation).withColumns({k: F.col(k) / F.col("gap") for k in way})


def window_fit(lines: DataFrame, interval: float, least: int) -> DataFrame:
    """The point ``a + b (t - tc)`` nearest to the lines of each window, from 28 sums.

    Sums are taken in axes of the window's own: the mean way of its lines and two
    across it.  Seen from afar lines are almost parallel, and what tells the
    distance is the small part across, which other axes would lose in rounding.
    """
    held = lines.withColumn("bin", F.floor(F.col("t") / interval))
    means = held.groupBy("line", "bin").agg(*[F.avg(f"u{c}").alias(f"m{c}") for c in XYZ], F.count("*").alias("m")).filter(F.col("m") >= least)
    axes = cut(means.withColumn("r", F.pandas_udf(frame, "array<double>")(F.struct("mx", "my", "mz"))).select("line", "bin", "r"))
    held = held.withColumn("dt", F.col("t") - (F.col("bin") + 0.5) * interval).join(axes, ["line", "bin"])
    turned = {f"{k}{c}": sum((F.col(f"{k}{b}") * F.col("r")[3 * i + j] for j, b in enumerate(XYZ)), F.lit(0.0)) for k in "uf" for i, c in enumerate(XYZ)}
    held = held.withColumn("top", F.col("fz")).withColumns(turned)
    # I - u u', and what it makes of the first return; 1 - ux * ux would lose the digits of a small rest
    across = {c: sum((F.col(f"u{o}") * F.col(f"u{o}") for o in XYZ if o != c), F.lit(0.0)) for c in XYZ}
    q = {f"q{a}{b}": across[a] if a == b else -F.col(f"u{a}") * F.col(f"u{b}") for i, a in enumerate(XYZ) for b in XYZ[i:]}
    held = held.withColumns(q)
    c = {f"c{a}": sum((F.col("q" + min(a, b) + max(a, b)) * F.col(f"f{b}") for b in XYZ), F.lit(0.0)) for a in XYZ}
    held = held.withColumns(c)
    sums = {f"{k}_{e}": F.sum(F.col(k) * F.pow("dt", F.lit(e))) for k in q for e in (0, 1, 2)} | {f"{k}_{e}": F.sum(F.col(k) * F.pow("dt", F.lit(e))) for k in c for e in (0, 1)}
    s = held.groupBy("line", "bin").agg(F.count("*").alias("n"), F.avg("t").alias("t"), F.max("top").alias("top"), F.first("r").alias("r"), *[v.alias(k) for k, v in sums.items()]).filter(F.col("n") >= least)

    @F.pandas_udf("array<double>")
    def solve(m: pd.DataFrame, turn: pd.Series) -> pd.Series:
        h, g = np.zeros((len(m), 6, 6)), np.zeros((len(m), 6))
        for i, a in enumerate(XYZ):
            g[:, i], g[:, 3 + i] = m[f"c{a}_0"], m[f"c{a}_1"]
            for j, b in enumerate(XYZ):
                k = "q" + min(a, b) + max(a, b)
                h[:, i, j], h[:, i, 3 + j], h[:, 3 + i, j], h[:, 3 + i, 3 + j] = m[f"{k}_0"], m[f"{k}_1"], m[f"{k}_1"], m[f"{k}_2"]
        own = np.diagonal(h, axis1=1, axis2=2)
        top = own.reshape(-1, 2, 3).max(2).repeat(3, axis=1)  # places and velocities each have a scale
        told = own > 1e-26 * top  # lines that are parallel to the last digits tell no distance
        scale = np.where(told, 1 / np.sqrt(np.where(told, own, 1.0)), 0.0)
        out = scale * np.einsum("nij,nj->ni", np.linalg.pinv(h * scale[:, :, None] * scale[:, None, :], rcond=1e-10, hermitian=True), g * scale)
        back = np.stack([np.asarray(v, float) for v in turn]).reshape(-1, 3, 3)
        return pd.Series(list(np.einsum("nij,nki->nkj", back, out.reshape(-1, 2, 3)).reshape(-1, 6)))

    return s.withColumn("s", solve(F.struct(*sums), "r")).select("line", "bin", "n", "t", "top", *[F.col("s")[i].alias(k) for i, k in enumerate(("ax", "ay", "az", "vx", "vy", "vz"))])


def frame(way: pd.DataFrame) -> pd.Series:
    """Nine numbers: the unit vector of a way and two across it, row by row."""
    e = way.to_numpy(float)
    long = np.linalg.norm(e, axis=1, keepdims=True)
    e = np.where(long > 0, e / np.where(long > 0, long, 1.0), [0.0, 0.0, 1.0])
    side = np.cross(e, np.eye(3)[np.abs(e).argmin(1)])
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    return pd.Series(list(np.concatenate([e, side, np.cross(e, side)], axis=1)))


def estimate_trajectory(returns: DataFrame, interval: float = 0.5, least: int = 30, separation: float = 2.0) -> DataFrame:
    """Where the sensor flew, from pulses of several returns: a place, a velocity and ``rms`` for each window of a line.

    Each such pulse is a line through the sensor.  Within ``interval`` seconds
    the sensor moves evenly, so its place and velocity follow by least squares;
    lines over three median distances (and 5 cm) away are left out of a second
    fit.  Windows of fewer than ``least`` pulses, or whose sensor comes out below
    their returns, give nothing.
    """
    lines = cut(pulse_lines(returns, separation))

    def measured(fits: DataFrame) -> DataFrame:
        held = lines.withColumn("bin", F.floor(F.col("t") / interval)).join(fits.drop("n", "t", "top"), ["line", "bin"])
        dt = F.col("t") - (F.col("bin") + 0.5) * interval
        held = held.withColumns({f"e{c}": F.col(f"f{c}") - F.col(f"a{c}") - F.col(f"v{c}") * dt for c in XYZ})
        crossed = (F.expr("ey * uz - ez * uy"), F.expr("ez * ux - ex * uz"), F.expr("ex * uy - ey * ux"))
        off = F.sqrt(sum((v * v for v in crossed), F.lit(0.0)))
        return held.withColumn("off", off).select(*lines.columns, "bin", "off")

    first = measured(cut(window_fit(lines, interval, least)))
    most = first.groupBy("line", "bin").agg(F.greatest(3 * F.percentile("off", F.lit(0.5)), F.lit(0.05)).alias("most"))
    kept = cut(first.join(most, ["line", "bin"]).filter("off <= most").select(*lines.columns))
    fits = cut(window_fit(kept, interval, least))
    rms = measured(fits).join(kept.select("line", "t"), ["line", "t"]).groupBy("line", "bin").agg(F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rms"))
    dt = F.col("t") - (F.col("bin") + 0.5) * interval
    out = fits.join(rms, ["line", "bin"]).withColumns({c: F.col(f"a{c}") + F.col(f"v{c}") * dt for c in XYZ})
    return out.filter("z > top").select("line", "bin", "t", *XYZ, "vx", "vy", "vz", "rms", "n")


# --- leaves ---------------------------------------------------------------------


def leaf_area_density(points: DataFrame, voxel: float = 0.25, side: float = 0.05, k: int = 12, limit: float = 1e3) -> DataFrame:
    """``ix, iy, iz, area, density`` of leaf points: each cube of a side stands for side² / (|nx| + |ny| + |nz|) of leaf.

    The first point of a cube (by pid) takes its normal from its k neighbours.
    """
    from .neighbours import shape

    cubes = [cell(c, side).alias(f"s{c}") for c in XYZ]
    thin = cut(points.groupBy(*cubes).agg(F.min_by(F.struct("pid", *XYZ), "pid").alias("p")).select("p.*"))
    area = side * side / (F.abs("nx") + F.abs("ny") + F.abs("nz"))
    held = thin.join(shape(thin, k, 2 * side, limit).select("pid", area.alias("area")), "pid")
    out = held.groupBy(*[cell(c, voxel).alias(f"i{c}") for c in XYZ]).agg(F.sum("area").alias("area"))
    return out.withColumn("density", F.col("area") / voxel**3)
