"""Trees: crowns on canopy rasters, stems in point clouds, and their measures."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell, finite
from ..plans.scratch import cut
from . import raster
from .points import tiled


def tree_tops(canopy: DataFrame, size: float, window: float = 5.0, least: float = 2.0) -> DataFrame:
    """Tops ``tree_id, row, col, x, y, height``; ids by order of x, then y.

    The number of a top is its place among all, found from counts by column so
    that no task sorts them all.
    """
    top = raster.local_maxima(canopy, size, window, least)
    counts = top.groupBy("col").agg(F.count("*").alias("n"))
    before = counts.select("col", (F.sum("n").over(Window.orderBy("col")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("col").orderBy("row"))
    held = top.join(before, "col").withColumn("tree_id", F.col("before") + rank - 1)
    return held.select("tree_id", "row", "col", ((F.col("col") + 0.5) * size).alias("x"), ((F.col("row") + 0.5) * size).alias("y"), F.col("value").alias("height"))


def grid_of(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
    shape = (int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1)
    h = np.full(shape, -np.inf)
    seed = np.full(shape, -1, "i8")
    r, c = pdf["row"].to_numpy() - r0, pdf["col"].to_numpy() - c0
    h[r, c] = pdf["value"]
    seed[r, c] = pdf["tree_id"].fillna(-1)
    return h, seed, r0, c0


def flood(h: np.ndarray, seed: np.ndarray, least: float) -> np.ndarray:
    """Watershed from the seeds, highest cells first, over eight neighbours."""
    label = seed.copy()
    queue = []
    order = 0
    for r, c in sorted(zip(*np.nonzero(seed >= 0), strict=True), key=lambda p: seed[p]):
        heapq.heappush(queue, (-h[r, c], order, r, c))
        order += 1
    while queue:
        _, _, r, c = heapq.heappop(queue)
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                a, b = r + dr, c + dc
                if 0 <= a < h.shape[0] and 0 <= b < h.shape[1] and label[a, b] < 0 and h[a, b] > least:
                    label[a, b] = label[r, c]
                    heapq.heappush(queue, (-h[a, b], order, a, b))
                    order += 1
    return label


def grow(h: np.ndarray, seed: np.ndarray, least: float, of_seed: float, of_crown: float, widest: float) -> np.ndarray:
    """Crowns grown from seeds in sweeps over four neighbours.

    A cell joins a crown if it is above ``least``, above a share of the seed's
    height and of the crown's mean, no more than 5 % above the seed, and near.
    All of a sweep's claims are judged on the crowns as they were before it; of
    two claims the smaller id's stands.
    """
    label = seed.copy()
    seeds = {int(seed[p]): p for p in zip(*np.nonzero(seed >= 0), strict=True)}
    if not seeds:
        return label
    ids = np.array(sorted(seeds))
    at = {k: i for i, k in enumerate(ids.tolist())}
    place = np.array([seeds[k] for k in ids.tolist()])
    high = h[place[:, 0], place[:, 1]]
    sums, counts = high.copy(), np.ones(len(ids))
    edge = [tuple(p) for p in place]
    while edge:
        claims: dict[tuple[int, int], int] = {}
        for r, c in edge:
            k = at[int(label[r, c])]
            for a, b in ((r - 1, c), (r, c - 1), (r, c + 1), (r + 1, c)):
                if not (0 <= a < h.shape[0] and 0 <= b < h.shape[1]) or label[a, b] >= 0:
                    continue
                v = h[a, b]
                near = max(abs(a - place[k, 0]), abs(b - place[k, 1])) < widest
                if v > least and v > high[k] * of_seed and v > sums[k] / counts[k] * of_crown and v <= high[k] * 1.05 and near:
                    claims[a, b] = min(claims.get((a, b), k), k)
        for (a, b), k in claims.items():
            label[a, b] = ids[k]
            sums[k] += h[a, b]
            counts[k] += 1
        edge = list(claims)
    return label


def crowns(canopy: DataFrame, tops: DataFrame, size: float, method: str = "watershed", least: float = 2.0, of_seed: float = 0.45, of_crown: float = 0.55, widest: float = 10.0, tile: float = 200.0, buffer: float = 30.0) -> DataFrame:
    """Cells of the canopy raster with their ``tree_id``; cells of no crown are left out.

    Crowns are grown on buffered tiles of the raster; a tile gives the cells of
    its own core, with the trees that start in its buffer taking part.
    """
    n, b = int(round(tile / size)), int(round(buffer / size))
    cells = canopy.join(tops.select("row", "col", "tree_id"), ["row", "col"], "left")
    spread = tiled(cells.withColumns({"x": F.col("col") + 0.5, "y": F.col("row") + 0.5}), float(n), buffer=float(b))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h, seed, r0, c0 = grid_of(pdf)
        label = flood(h, seed, least) if method == "watershed" else grow(h, seed, least, of_seed, of_crown, widest / size)
        core = pdf[pdf["core"]]
        own = label[core["row"].to_numpy() - r0, core["col"].to_numpy() - c0]
        out = pd.DataFrame({"row": core["row"].to_numpy(), "col": core["col"].to_numpy(), "value": core["value"].to_numpy(), "tree_id": own})
        return out[out["tree_id"] >= 0]

    return spread.select("tx", "ty", "core", "row", "col", "value", "tree_id").groupBy("tx", "ty").applyInPandas(run, "row long, col long, value double, tree_id long")


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of the convex hull in turn, by monotone chains."""
    p = sorted(set(zip(x.tolist(), y.tolist(), strict=True)))
    if len(p) < 3:
        return np.array(p, float).reshape(-1, 2)

    def chain(points):
        out = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(chain(p) + chain(p[::-1]))


def hull_area(x: np.ndarray, y: np.ndarray) -> float:
    a = hull(x, y)
    if len(a) < 3:
        return 0.0
    b = np.roll(a, -1, axis=0)
    return float(abs((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum()) / 2)


#: Places of a key up to which one task takes its hull as it stands, if blocks would hold few of them.
HULL_SPOTS = 20_000


def hull_corners(points: DataFrame, key: str, block: float = 5.0, spots: int = HULL_SPOTS, few: int = 20) -> DataFrame:
    """Points ``key, x, y`` that hold the hull's corners of each key: the corners of each block of it, or all of its places.

    The hull of a part's corners and the others' is the hull of all, so blocks
    are done apart and a key's last step sees a few points of each.  A key with
    no more than ``spots`` places, and ``few`` a block, is left whole: spread
    wide, it would have about as many blocks as places.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = hull(pdf["x"].to_numpy(), pdf["y"].to_numpy())
        return pd.DataFrame({key: pdf[key].iloc[0], "x": c[:, 0], "y": c[:, 1]})

    # equal places count once, before they meet
    places = cut(points.select(F.col(key).cast("long").alias(key), *[F.col(c).cast("double").alias(c) for c in "xy"]).distinct())
    blocks = [cell("x", block).alias("_bx"), cell("y", block).alias("_by")]
    held = places.groupBy(key, *blocks).agg(F.count("*").alias("_c")).groupBy(key).agg(F.sum("_c").alias("_n"), F.count("*").alias("_b"))
    large = cut(held.filter((F.col("_n") > spots) | (F.col("_n") > few * F.col("_b"))).select(key))
    parts = places.join(large, key, "left_semi").groupBy(key, *blocks).applyInPandas(run, f"{key} long, x double, y double")
    return places.join(large, key, "left_anti").unionByName(parts)


def crown_metrics(points: DataFrame, layer: float = 0.5, share: float = 0.3, height: str = "z") -> DataFrame:
    """Base, top, depth, area and diameter of each tree's crown.

    The crown begins at the first layer from a quarter of the height up that
    holds ``share`` of the fullest layer.  Its area is that of the convex hull
    of all its points.
    """
    p = points.filter((F.col("tree_id") >= 0) & finite(height)).withColumn("h", F.col(height).cast("double"))
    bins = p.groupBy("tree_id", F.greatest(cell("h", layer), F.lit(0)).alias("bin")).agg(F.count("*").alias("c"), F.max("h").alias("h"))
    w = Window.partitionBy("tree_id")
    b = bins.withColumns({"top": F.max("h").over(w), "most": F.max("c").over(w), "all": F.sum("c").over(w)})
    layers = F.greatest(F.ceil(F.col("top") / layer), F.lit(1))
    start = F.floor(layers / 4)
    full = (F.col("bin") >= start) & (F.col("c") >= share * F.col("most"))
    base = b.filter("all >= 4").groupBy("tree_id").agg(F.max("top").alias("top"), F.max("all").alias("n_points"), (F.min(F.when(full, F.col("bin"))) * layer).alias("base"))
    high = p.join(base, "tree_id").filter(F.col("h") >= F.col("base"))

    def area(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"tree_id": pdf["tree_id"].iloc[:1], "area": [hull_area(pdf["x"].to_numpy(), pdf["y"].to_numpy())]})

    rim = hull_corners(high, "tree_id").groupBy("tree_id").applyInPandas(area, "tree_id long, area double")
    held = base.join(rim, "tree_id")
    return held.select("tree_id", "n_points", "top", "base", (F.col("top") - F.col("base")).alias("depth"), "area", (2 * F.sqrt(F.col("area") / 3.141592653589793)).alias("diameter"))


def circle_fit(points: DataFrame, key: str) -> DataFrame:
    """Algebraic least-squares circle of each group, from sums alone."""
    means = points.groupBy(key).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    u, v = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    q = points.join(means, key).select(key, "mx", "my", u.alias("u"), v.alias("v"))
    s = q.groupBy(key, "mx", "my").agg(
        F.count("*").alias("n"), *[F.sum(e).alias(n) for n, e in {"uu": F.expr("u*u"), "vv": F.expr("v*v"), "uv": F.expr("u*v"), "uuu": F.expr("u*u*u"), "vvv": F.expr("v*v*v"), "uvv": F.expr("u*v*v"), "vuu": F.expr("v*u*u")}.items()]
    )
    fits = circles(s, F.lit(1e-12))
    return fits.select(key, "n", (F.col("mx") + F.col("cu")).alias("x"), (F.col("my") + F.col("cv")).alias("y"), "radius")


def circles(s: DataFrame, least: Column) -> DataFrame:
    """Centres ``cu, cv`` and ``radius`` from the sums about the mean; none where the determinant is not above ``least``."""
    det = F.expr("uu * vv - uv * uv")
    a, b = F.expr("(uuu + uvv) / 2"), F.expr("(vvv + vuu) / 2")
    ok = (F.col("n") >= 3) & (F.abs(det) > least)
    cu = F.when(ok, (a * F.col("vv") - b * F.col("uv")) / det)
    cv = F.when(ok, (b * F.col("uu") - a * F.col("uv")) / det)
    return s.withColumns({"cu": cu, "cv": cv}).withColumn("radius", F.sqrt(F.expr("cu * cu + cv * cv + (uu + vv) / n")))


def circle_fit_at(near: DataFrame, keys: list[str], x0: str, y0: str) -> DataFrame:
    """``keys, n, x, y, radius``: the circles of ``circle_fit`` from points near a known place ``x0, y0`` of each group.

    Sums about that place are shifted to the mean, so one aggregation, which is
    combined before its shuffle, is all: pairs of points and places never move.
    """
    p = near.withColumns({"_u": F.col("x") - F.col(x0), "_v": F.col("y") - F.col(y0)})
    sums = {"".join(t): F.sum(F.expr(" * ".join(f"_{c}" for c in t))) for t in ("u", "v", "uu", "vv", "uv", "uuu", "vvv", "uvv", "vuu")}
    s = p.groupBy(*keys).agg(F.first(x0).alias("_x0"), F.first(y0).alias("_y0"), F.count("*").alias("n"), *[v.alias(f"s{k}") for k, v in sums.items()])
    s = s.withColumns({"mu": F.expr("su / n"), "mv": F.expr("sv / n")})
    about = {
        "uu": "suu - n * mu * mu", "vv": "svv - n * mv * mv", "uv": "suv - n * mu * mv",
        "uuu": "suuu - 3 * mu * suu + 2 * n * mu * mu * mu", "vvv": "svvv - 3 * mv * svv + 2 * n * mv * mv * mv",
        "uvv": "suvv - 2 * mv * suv - mu * svv + 2 * n * mu * mv * mv", "vuu": "svuu - 2 * mu * suv - mv * suu + 2 * n * mv * mu * mu",
    }
    s = s.withColumns({k: F.expr(v) for k, v in about.items()})
    # what rounding of the shift may leave of points in one line is no circle
    fits = circles(s, F.greatest(F.lit(1e-12), F.expr("1e-13 * (suu + svv) * (suu + svv)")))
    return fits.select(*keys, "n", F.expr("_x0 + mu + cu").alias("x"), F.expr("_y0 + mv + cv").alias("y"), "radius")


def ransac_circle(x: np.ndarray, y: np.ndarray, tolerance: float, tries: int, seed: int) -> tuple[float, float, float, float]:
    """Centre, radius and share of inliers of the best of many circles through three points."""
    r = np.random.default_rng(seed)
    n = len(x)
    i = np.argsort(r.random((tries, n)), axis=1)[:, :3] if n < 64 else r.integers(0, n, (tries, 3))
    ax, ay, bx, by, cx, cy = x[i[:, 0]], y[i[:, 0]], x[i[:, 1]], y[i[:, 1]], x[i[:, 2]], y[i[:, 2]]
    d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
    d = np.where(np.abs(d) < 1e-12, np.nan, d)
    a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    ux = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d
    uy = (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
    rad = np.hypot(ax - ux, ay - uy)
    off = np.abs(np.hypot(x[None, :] - ux[:, None], y[None, :] - uy[:, None]) - rad[:, None])
    share = np.nan_to_num((off <= tolerance).mean(axis=1), nan=-1)
    k = int(share.argmax())
    return float(ux[k]), float(uy[k]), float(rad[k]), float(share[k])


def stem_slices(points: DataFrame, low: float = 1.0, high: float = 5.0, layer: float = 0.5, gap: float = 0.1, least: int = 20, tolerance: float = 0.015, largest: float = 1.0, tries: int = 200, seed: int = 1) -> DataFrame:
    """Circles of stems in layers: ``layer, cluster, x, y, radius, inliers, n_points``."""
    from .graph import clusters

    band = points.filter((F.col("z") >= low) & (F.col("z") < high)).withColumn("layer", F.floor((F.col("z") - low) / layer))
    # layers lie far apart in the third axis, so one run groups them all
    flat = band.select("pid", "x", "y", (F.col("layer") * 1000.0).alias("z"))
    groups = clusters(flat, gap, least).filter("cluster >= 0")
    held = band.join(groups, "pid")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        order = np.argsort(pdf["pid"].to_numpy())
        cx, cy, rad, share = ransac_circle(x[order], y[order], tolerance, tries, seed)
        row = {"layer": [pdf["layer"].iloc[0]], "cluster": [pdf["cluster"].iloc[0]], "x": [cx], "y": [cy], "radius": [rad], "inliers": [share], "n_points": [len(x)]}
        return pd.DataFrame(row)

    out = held.select("layer", "cluster", "pid", "x", "y").groupBy("layer", "cluster").applyInPandas(fit, "layer long, cluster long, x double, y double, radius double, inliers double, n_points long")
    return out.filter((F.col("radius") > 0.02) & (F.col("radius") <= largest) & (F.col("inliers") >= 0.5))


def stems(slices: DataFrame, offset: float = 0.3, least: int = 3, low: float = 1.0, layer: float = 0.5) -> DataFrame:
    """Stems of slices that stand above each other: ``stem, x, y, dbh, n_slices``.

    The diameter at breast height comes from a line through the slices' radii.
    """
    from .graph import components
    from .neighbours import radius_join

    s = slices.select(F.col("cluster").alias("pid"), "x", "y", "layer", "radius", "inliers")
    q = s.select(F.col("pid").alias("src"), "x", "y", F.col("layer").alias("l0"), F.col("radius").alias("r0"))
    near = radius_join(q, s, offset, 2, keep=("src", "l0", "r0")).filter("src < pid and abs(layer - l0) between 1 and 2 and greatest(radius, r0) <= 2 * least(radius, r0)")
    found = components(s, near.select("src", F.col("pid").alias("dst")))
    held = s.join(found, "pid").withColumn("h", (F.col("layer") + 0.5) * layer + low)
    g = held.groupBy(F.col("component").alias("stem")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.countDistinct("layer").alias("n_slices"), F.regr_slope("radius", "h").alias("s"), F.regr_intercept("radius", "h").alias("i"), F.avg("radius").alias("r"))
    return g.filter(F.col("n_slices") >= least).select("stem", "x", "y", (2 * F.coalesce(F.col("i") + 1.3 * F.col("s"), F.col("r"))).alias("dbh"), "n_slices")


def li_2012(points: DataFrame, near: float = 1.5, far: float = 2.0, split: float = 15.0, least: float = 2.0, search: float = 10.0, tile: float = 100.0, buffer: float = 20.0) -> DataFrame:
    """Points with ``tree``, by growing trees from the top down on buffered tiles.

    The highest free point starts a tree; lower ones join it if they are nearer
    to it than to what was turned away, by a spacing of ``near`` below ``split``
    and ``far`` above.  A tree is named by its highest point, and a tile gives
    the points of its core; points that belong to no tree are left out.
    """
    high = tiled(points.filter(F.col("z") >= least).select("pid", "x", "y", "z"), tile, buffer=buffer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {c: [] for c in ("pid", "x", "y", "z", "core")}
        for batch in batches:
            for c, v in held.items():
                v.append(batch.column(c).to_numpy(zero_copy_only=False))
        pid, x, y, z, core = (np.concatenate(held.pop(c)) for c in ("pid", "x", "y", "z", "core"))
        order = np.lexsort((pid, -z))
        pid, x, y, z, core = (v[order] for v in (pid, x, y, z, core))
        # a point goes where the highest one of its place goes
        order = np.lexsort((y, x))
        new = np.r_[True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0)]
        first = order[new]
        down = np.argsort(first)
        place = np.empty(len(x), "i4")
        rank = np.empty(len(first), "i4")
        rank[down] = np.arange(len(first))
        place[order] = rank[np.cumsum(new) - 1]
        first = first[down]
        del order, new, rank, down
        top = grown(np.column_stack([x[first], y[first]]), np.where(z[first] > split, far, near), search)
        own = np.flatnonzero(core)
        named = pid[first[top]]
        for a in range(0, len(own), 100_000):
            some = own[a : a + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(pid[some]), pa.array(named[place[some]])], names=["pid", "tree"])

    return high.groupBy("tx", "ty").applyInArrow(run, "pid long, tree long")


#: Distances that a search holds at once.
EARLIER = 1_000_000


def earlier(xy: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``q, p, d``: of each asked place (by number, above 0) the nearest places of smaller number, all equally near ones.

    Among the first places a search takes wide cells, among many narrow ones, and
    a cell gives its places up to the asked number only.
    """
    low = xy.min(axis=0)
    extent = float((xy.max(axis=0) - low).max())
    level = np.frexp(asked)[1]
    out = []
    for k in np.unique(level):
        some, n, side = asked[level == k], min(len(xy), 1 << int(k)), max(extent * 2.0 ** (-(k - 1) / 2), 1e-9)
        while len(some):
            at = np.floor((xy[:n] - low) / side).astype("i8") + 1
            wide = at[:, 1].max() + 2
            cells = at[:, 0] * wide + at[:, 1]
            order = np.argsort(cells, kind="stable")
            key = cells[order] * n + order
            steps = np.array([i * wide + j for i in (-1, 0, 1) for j in (-1, 0, 1)])
            lo, hi = (np.searchsorted(key, (cells[some][:, None] + steps) * n + u) for u in (0, some[:, None]))
            count = hi - lo
            held = count.sum(axis=1)
            open_ = [some[held == 0]]
            some, lo, count, held = (v[held > 0] for v in (some, lo, count, held))
            parts = np.flatnonzero(np.diff(np.cumsum(held) // EARLIER, prepend=0)) if len(some) else []
            for a, b in zip([0, *parts], [*parts, len(some)], strict=True):
                if a == b:
                    continue
                each = count[a:b].reshape(-1)
                ends = np.cumsum(each)
                p = order[np.arange(ends[-1]) + np.repeat(lo[a:b].reshape(-1) - (ends - each), each)]
                starts = np.cumsum(held[a:b]) - held[a:b]
                q = np.repeat(some[a:b], held[a:b])
                d = np.hypot(xy[p, 0] - xy[q, 0], xy[p, 1] - xy[q, 1])
                best = np.minimum.reduceat(d, starts)
                sure = (best <= side * (1 - 1e-9)) | (side > 2 * extent)
                keep = (d == np.repeat(best, held[a:b])) & np.repeat(sure, held[a:b])
                out.append((q[keep], p[keep], d[keep]))
                open_.append(some[a:b][~sure])
            some, side = np.concatenate(open_), 2 * side
    q, p, d = (np.concatenate(v) for v in zip(*out, strict=True)) if out else (np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0))
    by = np.argsort(q, kind="stable")
    return q[by], p[by], d[by]


def grown(xy: np.ndarray, limit: np.ndarray, search: float) -> np.ndarray:
    """The number of its tree's top for each of different places, which stand from the highest down.

    Until a place is turned away, what is within its limit joins; from then on each
    goes with the nearest one before it, of equally near ones with the tree's.
    """
    label = np.full(len(xy), -1, "i8")
    free = np.arange(len(xy))
    known = np.full(len(xy), -1, "i8")  # the nearest of all free ones before, where it stands alone
    spot = np.full(len(xy), -1, "i8")
    while len(free):
        top = free[0]
        off = np.hypot(*(xy[free] - xy[top]).T)
        close, off = free[off <= search], off[off <= search]
        spot[close] = np.arange(len(close))
        label[top] = top
        if len(close) > 1:
            here = xy[close]
            before = np.where(known[close] >= 0, spot[known[close]], -1)
            q, p, d = earlier(here, np.flatnonzero(before[1:] < 0) + 1)
            n = np.bincount(q, minlength=len(close))
            one = n[q] == 1
            before[q[one]] = p[one]
            sure = one & (off[q] + d <= search * (1 - 1e-9))
            known[close[q[sure]]] = close[p[sure]]
            tied: dict[int, list[int]] = {}
            for i, j in zip(q[~one].tolist(), p[~one].tolist(), strict=True):
                tied.setdefault(i, []).append(j)
            some = np.flatnonzero(before >= 0)
            gap = np.zeros(len(close))
            gap[some] = np.hypot(*(here[before[some]] - here[some]).T)
            gap[q[~one]] = d[~one]
            away = np.flatnonzero(gap > limit[close])
            if len(away):
                mine = [True] * int(away[0]) + [False]
                for i, j in enumerate(before[len(mine) :].tolist(), len(mine)):
                    mine.append(mine[j] if j >= 0 else any(mine[t] for t in tied[i]))
                label[close[np.array(mine)]] = top
            else:
                label[close] = top
        spot[close] = -1
        free = free[label[free] < 0]
    return label


def prune(found: DataFrame, distance: float, quality: str = "n_points", dims: int = 2) -> DataFrame:
    """Trees ``tree_id, x, y`` without those that stand within ``distance`` of a better one.

    Better is more of ``quality``, of equals the smaller id; a tree yields only to
    one that is not yielding itself, so the best of a chain stays.
    """
    from .graph import tiled_nodes
    from .neighbours import radius_join

    axes = ("x", "y", "z")[:dims]
    q = found.select(F.col("tree_id").alias("id"), *axes, F.col(quality).alias("q0"))
    near = radius_join(q, found.select(F.col("tree_id").alias("pid"), *axes, F.col(quality).alias("q1")), distance, dims, keep=("id", "q0"), many=True)
    pairs = near.filter((F.col("id") != F.col("pid")) & ((F.col("q1") > F.col("q0")) | ((F.col("q1") == F.col("q0")) & (F.col("pid") < F.col("id"))))).select("id", "q0", F.col("pid").alias("better"))
    tiles = tiled_nodes(found.select(F.col("tree_id").alias("pid"), "x", "y"), PRUNE_TILE).withColumnRenamed("pid", "id")
    waiting = cut(pairs.join(tiles, "id"))
    settled = cut(found.select(F.col("tree_id").alias("id")).join(waiting.select("id").distinct(), "id", "left_anti").withColumn("stays", F.lit(True)))
    while not waiting.isEmpty():
        known = settled.withColumnsRenamed({"id": "better"})
        new = cut(waiting.join(known, "better", "left").groupBy("tile").applyInPandas(settle_tile, "id long, stays boolean"))
        waiting = cut(waiting.join(new.select("id"), "id", "left_anti"))
        settled = cut(settled.union(new))
    return found.join(settled.filter("stays").select(F.col("id").alias("tree_id")), "tree_id", "left_semi")


#: Trees or points of a tile, in which one task settles whole chains.
PRUNE_TILE = 20_000


def settle_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of one tile: what is settled by better ones that are settled already, or become so here.

    The best comes first, so one pass takes a chain to its end; only what waits
    for another tile is left.
    """
    pdf = pdf.sort_values(["q0", "id"], ascending=[False, True], na_position="first", kind="stable")
    own: dict[int, bool | None] = {}
    group, beaten, unknown = None, False, False

    def close() -> None:
        if group is not None:
            own[group] = False if beaten else None if unknown else True

    for i, better, stays in zip(pdf["id"].tolist(), pdf["better"].tolist(), pdf["stays"].tolist(), strict=True):
        if i != group:
            close()
            group, beaten, unknown = i, False, False
        now = own.get(better) if stays is None or stays != stays else stays
        beaten, unknown = beaten or now is True, unknown or now is None
    close()
    done = [(i, v) for i, v in own.items() if v is not None]
    return pd.DataFrame({"id": [i for i, _ in done], "stays": [v for _, v in done]})


def contacts(points: DataFrame, distance: float) -> DataFrame:
    """Pairs of trees that come within ``distance``: ``a, b, n, nearest, height``."""
    from .neighbours import radius_join

    p = points.filter("tree_id >= 0").select("pid", "x", "y", "z", "tree_id")
    q = p.select(F.col("tree_id").alias("a"), "x", "y", "z")
    near = radius_join(q, p, distance, 3, keep=("a",)).filter(F.col("a") < F.col("tree_id"))
    return near.groupBy("a", F.col("tree_id").alias("b")).agg(F.count("*").alias("n"), F.sqrt(F.min("d2")).alias("nearest"), F.avg("z").alias("height"))


#: Points that the first round of thinning takes.
FIRST_THINNED = 200_000
#: Kept points up to which their pids are broadcast.
BROADCAST_KEPT = 500_000


def min_distance_subsample(points: DataFrame, distance: float) -> DataFrame:
    """Points so that no two kept ones are nearer than ``distance``; a point goes if an earlier kept one is that near.

    The earliest points settle first, then twice as many, and so on; of each
    share only what stands near no kept point is asked, so that tasks hold what is
    kept and few others, however dense the points are.
    """
    from .nearby import tile_width

    near = math.nextafter(distance, 0.0)  # a point at the distance itself stays
    known = finite("x") & finite("y") & finite("z")
    p = points.filter(known).select("pid", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    rounds = max(0, math.ceil(math.log2(max(p.count(), 1) / FIRST_THINNED)))
    limits = p.agg(F.percentile_approx("pid", F.array(*[F.lit(0.5**k) for k in range(rounds, 0, -1)]))).first()[0] if rounds else []
    width = tile_width(p, least=4 * distance) if rounds else 0.0
    kept, low = None, None
    for high in [*dict.fromkeys(limits), None]:
        part = p if low is None else p.filter(F.col("pid") > low)
        part = part if high is None else part.filter(F.col("pid") <= high)
        new = thinned(part if kept is None else cut(uncovered(part, kept, near, width)), distance)
        kept, low = new if kept is None else cut(kept.union(new)), high
    stays = kept.select("pid").union(points.filter(~known).select("pid"))
    stays = F.broadcast(stays) if kept.count() <= BROADCAST_KEPT and points.columns != ["pid"] and points.filter(~known).isEmpty() else stays
    return points.join(stays, "pid", "left_semi").select(*points.columns)


def uncovered(points: DataFrame, kept: DataFrame, near: float, width: float) -> DataFrame:
    """Points that have no kept one within ``near``, by tiles of a width."""
    from .fit import closest_in_task
    from .nearby import arrays, dealt

    names = ("pid", "x", "y", "z", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, x, y, z, old = arrays(batches, names)
        xyz = np.column_stack([x, y, z])
        ask, new = closest_in_task(xyz[old], pid[old], near), np.flatnonzero(~old)
        for a in range(0, len(new), 20_000):
            some = new[a : a + 20_000]
            some = some[ask(xyz[some])[0] < 0]
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(v[some])) for v in (pid, x, y, z)], names=list(names[:4]))

    own = points.select(cell("x", width).alias("tx"), cell("y", width).alias("ty"), *names[:4], F.lit(False).alias("kept"))
    rows = own.union(dealt(kept, width, near).select("tx", "ty", *names[:4], F.lit(True).alias("kept")))
    return rows.groupBy("tx", "ty").applyInArrow(run, "pid long, x double, y double, z double")


def thinned(points: DataFrame, distance: float) -> DataFrame:
    """Of ``pid, x, y, z`` what is kept by ``min_distance_subsample``.

    A task settles whole chains of neighbours within its tile, so rounds follow
    the tiles that a chain crosses, not its points; a kept point sends away the later
    ones around it at once, so that no pair is stored.
    """
    from .graph import tiled_points

    near = math.nextafter(distance, 0.0)
    ways, _ = tiled_points(points, distance)
    waiting = ways.withColumn("stays", F.lit(None).cast("boolean"))
    while True:
        found = cut(waiting.groupBy("tile").applyInPandas(thin_tile(near), "pid long, stays boolean, x double, y double, z double"))
        if found.filter("stays is null").isEmpty():
            return found.filter("stays").select("pid", "x", "y", "z")
        # what is gone matters to none
        waiting = cut(waiting.drop("stays").join(found.filter("stays is null or stays").select("pid", "stays"), "pid").select(*ways.columns, "stays").repartition("tile"))


def thin_tile(near: float):
    """Of one tile, ``pid, stays`` and the places of its own points: null where that hangs on an open point of another tile."""
    from .graph import looked_up

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pid", kind="stable")
        pid, own = pdf["pid"].to_numpy("i8"), (pdf["home"] == pdf["tile"]).to_numpy()
        sure = (pdf["stays"].astype("boolean").fillna(False)).to_numpy(bool)
        xyz = pdf[["x", "y", "z"]].to_numpy("f8")
        cells, beside = looked_up(xyz, near)
        gone, blocked = np.zeros(len(pid), bool), np.zeros(len(pid), bool)
        for i in range(len(pid)):
            if gone[i]:
                continue
            kept = sure[i] or own[i] and not blocked[i]
            blocked[i] = not kept
            held, x, y, z = beside(cells[i])
            x, y, z = x - xyz[i, 0], y - xyz[i, 1], z - xyz[i, 2]
            later = held[x * x + y * y + z * z <= near * near]
            (gone if kept else blocked)[later[pid[later] > pid[i]]] = True
        stays = pd.Series(np.where(gone, 0, 1), dtype="boolean").mask(blocked & ~gone)
        return pd.DataFrame({"pid": pid[own], "stays": stays[own], "x": xyz[own, 0], "y": xyz[own, 1], "z": xyz[own, 2]})

    return run


def dbh_profile(points: DataFrame, stems: DataFrame, step: float = 0.5, thickness: float = 0.1, search: float = 0.75, height: str = "z") -> DataFrame:
    """Taper of stems ``stem, x, y``: ``stem, slice, height, n, x, y, diameter`` of a circle in each thin slice.

    Slices stand at multiples of ``step``; points within ``search`` of the stem's
    centre take part, and a point near two stems does in both.
    """
    from .neighbours import places, radius_join

    k = F.floor(F.col(height) / step + 0.5)
    thin = points.withColumn("slice", k).filter(F.abs(F.col(height) - F.col("slice") * step) <= thickness / 2)
    shared = places(stems, ("x", "y"), "stem")
    spots = stems if shared is None else shared[0]
    q = spots.select("stem", "x", "y", F.col("x").alias("sx"), F.col("y").alias("sy"))
    fits = circle_fit_at(radius_join(q, thin.select("x", "y", "slice"), search, 2, keep=("stem", "sx", "sy")), ["stem", "slice"], "sx", "sy")
    if shared is not None:
        fits = fits.withColumnRenamed("stem", "place").join(shared[1], "place")
    return fits.select("stem", "slice", (F.col("slice") * step).alias("height"), "n", "x", "y", (2 * F.col("radius")).alias("diameter"))


def segment_trees(points: DataFrame, stems: DataFrame, reach: float = 1.0, power: float = 2.0, seed_height: float = 1.5, seed_radius: float = 0.25, most: float = float("inf")) -> DataFrame:
    """``pid, tree_id, dist``: each point's stem by the cheapest path through near points.

    Paths start from the points within ``seed_radius`` of a stem ``stem, x, y``
    and up to ``seed_height``; a step costs its length to the ``power``, so that
    gaps cost more than the same way in small steps.  Points that no path
    reaches have no tree.  A seed near two stems goes to the nearer one.
    """
    from .graph import near_paths
    from .neighbours import radius_join

    low = points.filter(F.col("z") <= seed_height).select("pid", "x", "y")
    near = radius_join(stems.select(F.col("stem").alias("id"), "x", "y"), low, seed_radius, 2)
    seeds = cut(near.groupBy("pid").agg(F.min_by("id", F.struct("d2", "id")).alias("tree_id")))
    paths = near_paths(points, reach, seeds.select("pid"), power, most)
    return paths.join(seeds.withColumnRenamed("pid", "source"), "source", "left").select("pid", "tree_id", "dist")


def variable_tops(canopy: DataFrame, size: float, intercept: float, slope: float, widest: float, least: float = 2.0) -> DataFrame:
    """Cells that no higher one stands near, in a window that grows with the cell's height.

    The window's diameter is ``intercept + slope * height``, ``widest`` at most;
    of equal cells the first by column, then row, stands.
    """
    from ..functions.cells import around

    tall = canopy.filter(F.col("value") >= least)
    window = F.least(F.lit(float(intercept)) + F.lit(float(slope)) * F.col("value"), F.lit(float(widest)))
    other = around(tall.select(F.col("row").alias("row2"), F.col("col").alias("col2"), F.col("value").alias("value2")).withColumns({"row": F.col("row2"), "col": F.col("col2")}), ["row", "col"], int(widest / 2 / size))
    d2 = ((F.col("row") - F.col("row2")) ** 2 + (F.col("col") - F.col("col2")) ** 2) * (size * size)
    first = (F.col("col2") < F.col("col")) | ((F.col("col2") == F.col("col")) & (F.col("row2") < F.col("row")))
    higher = (F.col("value2") > F.col("value")) | ((F.col("value2") == F.col("value")) & first)
    beaten = tall.join(other, ["row", "col"]).filter((d2 > 0) & (4 * d2 <= window * window) & higher)
    return tall.join(beaten.select("row", "col").distinct(), ["row", "col"], "left_anti")
