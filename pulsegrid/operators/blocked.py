"""Voxel grids in blocks: pulses are routed to the blocks that they cross, and traced there.

A pulse becomes one piece for each block, which carries the state in which it
enters: where its first echo lies, and whether it still runs or ended before.
A block's voxels are summed in arrays of one block's size, so a fine grid costs a
task no more than a coarse one, and what is shuffled follows the blocks that pulses
cross and not their voxels.  A block with many pieces (that of the scanner) is
dealt over several tasks.  The table is stored by block, and a box reads its own
blocks only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import cell, ratio
from ..plans.scratch import cut
from .trees import hull, hull_corners
from .voxels import FIELDS, crossings

BLOCK_KEYS = ("bx", "by", "bz")
ALL_FIELDS = (*FIELDS, "hidden")
SEEN, HIDDEN, HIT = 0, 1, 2
#: Pieces that one task traces of a block, and blocks whose counts are broadcast.
PIECES, BROADCAST_BLOCKS = 200_000, 200_000
#: Voxels of a hull's box that are looked at together, times its corners.
CELLS = 2_000_000
PIECE = T.StructType([T.StructField(c, T.LongType()) for c in BLOCK_KEYS] + [T.StructField("kind", T.IntegerType())] + [T.StructField(c, T.DoubleType()) for c in ("ox", "oy", "oz", "dx", "dy", "dz", "near", "far", "first")])
SUMS = T.StructType([T.StructField(c, T.LongType()) for c in (*BLOCK_KEYS, "ix", "iy", "iz")] + [T.StructField(c, T.DoubleType()) for c in ALL_FIELDS])


def routed(o: np.ndarray, d: np.ndarray, ray: np.ndarray, where: np.ndarray, enter: np.ndarray, leave: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Rays and blocks, with those too that only rounding tells apart from a ray's own.

    A ray along a block's side or through its edge may have the middle of a voxel's
    piece on the other side of it than the middle of the block's; each block keeps
    what lies in it, so one too many changes nothing.
    """
    last = np.r_[ray[1:] != ray[:-1], True] if len(ray) else np.zeros(0, bool)
    first = np.r_[True, last[:-1]] if len(ray) else last
    out = [np.column_stack([ray, where])]
    for t, outer in ((enter, first), (leave, last)):
        p = o[ray] + d[ray] * t[:, None]
        slack = 1e-9 * (np.abs(p) + width)
        low, high = np.floor((p - slack) / width).astype("i8"), np.floor((p + slack) / width).astype("i8")
        sides = (low != high).sum(1)
        # where one plane is crossed, the blocks on both sides are there already
        go = np.flatnonzero((sides > 1) | (outer & (sides > 0)))
        for corner in np.ndindex(2, 2, 2):
            out.append(np.column_stack([ray[go], np.where(corner, high[go], low[go])]))
    every = out[0] if all(not len(x) for x in out[1:]) else np.unique(np.concatenate(out), axis=0)
    return every[:, 0], every[:, 1:]


def pieces(rays: DataFrame, size: float, block: int) -> DataFrame:
    """A row for each pulse and block that it crosses, as far as its last echo and, hidden, from there to ``reach``; and one for each echo."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(PIECE)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                o, d = (np.stack([cols[f"{k}{a}"].to_numpy(zero_copy_only=False) for a in "xyz"], 1).astype(float) for k in "od")
                lists = cols["ranges"]
                n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(float)
                ends = np.cumsum(n)
                reach = cols["reach"].to_numpy(zero_copy_only=False).astype(float)
                first, last = np.full(len(n), np.inf), reach.copy()
                some = n > 0
                first[some], last[some] = flat[(ends - n)[some]], flat[(ends - 1)[some]]
                out = []
                for kind, near, far in ((SEEN, np.zeros(len(n)), last), (HIDDEN, last, np.maximum(last, reach))):
                    go = np.flatnonzero(far > near)
                    start = o[go] + d[go] * near[go, None]
                    ray, where = routed(start, d[go], *crossings(start, o[go] + d[go] * far[go, None], size, block), size * block)
                    ray = go[ray]
                    out.append((where, np.full(len(ray), kind), ray, near[ray], far[ray], first[ray]))
                owner = np.repeat(np.arange(len(n)), n)
                voxel = np.floor((o[owner] + d[owner] * np.nextafter(flat, 0)[:, None]) / size).astype("i8").reshape(-1, 3)
                # an echo has no far end; its place says whether it is its pulse's first
                out.append((voxel // block, np.full(len(owner), HIT), owner, flat, (np.diff(owner, prepend=-1) != 0).astype(float), first[owner]))
                where, kind, ray, near, far, state = (np.concatenate(x) for x in zip(*out, strict=True))
                columns = [*where.T, kind, *o[ray].T, *d[ray].T, near, far, state]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    cols = rays.select("ox", "oy", "oz", "dx", "dy", "dz", F.col("reach").cast("double").alias("reach"), F.col("ranges").cast("array<double>").alias("ranges"))
    return cols.mapInArrow(run, PIECE)


def summed(found: DataFrame, size: float, block: int) -> DataFrame:
    """Voxel sums of pieces that come block by block."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SUMS)
    cells = block**3

    def run(batches):
        key, grid = None, np.zeros((0, 0))

        def emit():
            used = np.flatnonzero(grid.any(0))
            place = np.stack(np.unravel_index(used, (block,) * 3), 1) + np.array(key) * block
            columns = [*[np.full(len(used), k) for k in key], *place.T, *grid[:, used]]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for batch in batches:
            c = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            keys = np.stack([c[k] for k in BLOCK_KEYS], 1)
            edges = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(1)]) if len(keys) else []
            for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
                here = tuple(keys[a].tolist())
                if here != key:
                    if key is not None:
                        yield emit()
                    key, grid = here, np.zeros((len(ALL_FIELDS), cells))
                o, d = (np.stack([c[f"{k}{x}"][a:b] for x in "xyz"], 1) for k in "od")
                kind, near, far, first = (c[k][a:b] for k in ("kind", "near", "far", "first"))
                low = np.array(here) * block

                def flat(voxel, low=low):
                    v = voxel - low
                    return (v[:, 0] * block + v[:, 1]) * block + v[:, 2]

                def add(field, where, values=None, grid=grid):
                    grid[ALL_FIELDS.index(field)] += np.bincount(where, values, cells)

                for i in range(0, b - a, 4096):
                    run_ = np.flatnonzero(kind[i : i + 4096] != HIT) + i
                    ray, voxel, t0, t1 = crossings(o[run_] + d[run_] * near[run_, None], o[run_] + d[run_] * far[run_, None], size, within=(low, block))
                    ray = run_[ray]
                    t0, t1 = t0 + near[ray], t1 + near[ray]
                    where = flat(voxel)
                    seen = kind[ray] == SEEN
                    add("rays", where[seen])
                    add("path", where[seen], (t1 - t0)[seen])
                    add("free_path", where[seen], np.clip(np.minimum(t1, first[ray]) - t0, 0, None)[seen])
                    add("hidden", where[~seen])
                    hit = np.flatnonzero(kind[i : i + 4096] == HIT) + i
                    where = flat(np.floor((o[hit] + d[hit] * np.nextafter(near[hit], 0)[:, None]) / size).astype("i8"))
                    add("hits", where)
                    add("intercepted", where, far[hit])
        if key is not None:
            yield emit()

    return found.select(*PIECE.names).mapInArrow(run, SUMS)


def trace(rays: DataFrame, size: float, block: int = 64) -> DataFrame:
    """``bx..bz, ix..iz`` with the sums of ``voxels.trace``, and ``hidden``: pulses that ended before but pointed here.

    ``rays(ox, oy, oz, dx, dy, dz, reach, ranges)`` as there; the sums are the same.
    """
    found = cut(pieces(rays, size, block))
    counts = cut(found.groupBy(*BLOCK_KEYS).agg(F.ceil(F.count("*") / PIECES).alias("parts")))
    side = F.broadcast(counts) if counts.count() <= BROADCAST_BLOCKS else counts
    dealt = found.join(side, list(BLOCK_KEYS)).withColumn("part", F.pmod(F.xxhash64("ox", "oy", "oz", "dx", "dy", "dz", "near"), "parts"))
    keys = [*BLOCK_KEYS, "part"]
    sums = summed(dealt.repartition(*keys).sortWithinPartitions(*keys), size, block)
    return sums.groupBy(*BLOCK_KEYS, "ix", "iy", "iz").agg(*[F.sum(f).alias(f) for f in ALL_FIELDS])


def write(grid: DataFrame, path: str) -> None:
    """Store a traced grid by block."""
    grid.repartition(*BLOCK_KEYS).write.mode("overwrite").partitionBy(*BLOCK_KEYS).parquet(path)


def open_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*SUMS.names)


def read_box(grid: DataFrame, box: tuple[int, int, int, int, int, int], block: int = 64) -> DataFrame:
    """Voxels of a box of indices, both ends included; blocks outside are not opened."""
    inside = F.lit(True)
    for k, (lo, hi) in zip("xyz", zip(box[::2], box[1::2], strict=True), strict=True):
        inside = inside & F.col(f"b{k}").between(lo // block, hi // block) & F.col(f"i{k}").between(lo, hi)
    return grid.filter(inside)


def states(grid: DataFrame, least: float = 1.0) -> DataFrame:
    """Voxels with ``state``: observed by at least ``least`` pulses, or occluded; all others, which the table lacks, are unobserved."""
    seen = F.when(F.col("rays") >= least, "observed").when((F.col("hidden") > 0) | (F.col("rays") > 0), "occluded").otherwise("unobserved")
    return grid.withColumn("state", seen)


def envelopes(points: DataFrame, size: float, key: str = "tree_id") -> DataFrame:
    """``key, ix, iy, iz``: voxels whose middle lies in the hull of a group's points in their layer, grown by half a voxel."""
    half = size / 2
    layers = points.select(key, cell("z", size).alias("iz"), "x", "y").distinct()
    # groups and layers in one number, for hulls that are taken in parts
    names = cut(layers.select(key, "iz").distinct().withColumn("name", F.monotonically_increasing_id()))
    corners = hull_corners(layers.join(names, [key, "iz"]).select("name", "x", "y"), "name")
    rims = corners.groupBy("name").agg(F.collect_list(F.struct("x", "y")).alias("p")).join(names, "name").select(F.col(key).cast("long"), "iz", F.col("p.x").alias("xs"), F.col("p.y").alias("ys"))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                k, iz, xs, ys = (c[i].as_py() for c in batch.columns)
                x, y = (np.array(v)[:, None] + s for v, s in ((xs, np.array([-half, half, -half, half])), (ys, np.array([-half, -half, half, half]))))
                ring = hull(x.ravel(), y.ravel())
                low, high = np.floor(ring.min(0) / size).astype("i8"), np.floor(ring.max(0) / size).astype("i8")
                side = np.roll(ring, -1, 0) - ring
                iy = np.arange(low[1], high[1] + 1)
                step = max(1, CELLS // (len(iy) * len(ring)))
                for first in range(low[0], high[0] + 1, step):  # so many columns at a time: wide hulls stay small
                    ix = np.arange(first, min(first + step, high[0] + 1))
                    gx, gy = (v.ravel() for v in np.meshgrid(ix, iy, indexing="ij"))
                    cx, cy = (gx + 0.5) * size, (gy + 0.5) * size
                    inside = np.ones(len(gx), bool)
                    for (px, py), (sx, sy) in zip(ring, side, strict=True):
                        inside &= sx * (cy - py) - sy * (cx - px) >= -1e-12
                    m = int(inside.sum())
                    if m:
                        yield pa.RecordBatch.from_arrays([pa.array([k] * m, pa.int64()), pa.array(gx[inside]), pa.array(gy[inside]), pa.array([iz] * m, pa.int64())], names=[key, "ix", "iy", "iz"])

    return rims.mapInArrow(run, f"{key} long, ix long, iy long, iz long")


def tree_sampling(grid: DataFrame, points: DataFrame, size: float, least: float = 10.0, above: float = 2.0) -> DataFrame:
    """How well each tree was seen: shares of its crown envelope's voxels by state, pulses in them, and what stands over its top.

    ``points(x, y, z, tree_id)``, negative ids left out.  ``above_observed``: of the
    voxels up to ``above`` over the highest point, within the footprint of the top
    metre, the share that was observed.
    """
    own = points.filter(F.col("tree_id") >= 0).select(F.col("tree_id").cast("long").alias("tree_id"), "x", "y", "z")
    seen = cut(states(grid).select("ix", "iy", "iz", "rays", "state"))
    around = cut(envelopes(own, size))
    ends = around.groupBy("tree_id").agg(F.min("iz").alias("z0"), F.max("iz").alias("z1"))
    held = around.join(seen, ["ix", "iy", "iz"], "left").join(ends, "tree_id")
    beams = F.when(F.col("state") == "observed", F.col("rays")).otherwise(0.0)
    quarter = F.least(F.floor((F.col("iz") - F.col("z0")) * 4 / (F.col("z1") - F.col("z0") + 1)), F.lit(3))
    held = held.select("tree_id", F.coalesce("state", F.lit("unobserved")).alias("state"), F.coalesce(beams, F.lit(0.0)).alias("beams"), quarter.alias("quarter"))
    n = F.count("*")

    def share(condition):
        return F.count(F.when(condition, 1)) / n

    out = held.groupBy("tree_id").agg(
        n.alias("n_voxels"),
        (n * size**3).alias("volume"),
        *[share(F.col("state") == s).alias(s) for s in ("observed", "occluded", "unobserved")],
        F.percentile("beams", 0.5).alias("median_beams"),
        F.percentile("beams", 0.1).alias("p10_beams"),
        F.array(*[F.percentile(F.when(F.col("quarter") == q, F.col("beams")), F.lit(0.5)) for q in range(4)]).alias("beams_by_quarter"),
        share((F.col("state") == "observed") & (F.col("beams") >= least)).alias("well_sampled"),
    )
    tops = own.groupBy("tree_id").agg(F.max("z").alias("top"))
    head = own.join(tops, "tree_id").filter(F.col("z") >= F.col("top") - 1.0)
    foot = envelopes(head.withColumn("z", F.lit(0.0)), size).drop("iz").join(tops, "tree_id")
    rise = foot.withColumn("iz", F.explode(F.sequence(F.floor(F.col("top") / size) + 1, F.floor((F.col("top") + above) / size))))
    over = rise.filter(F.col("iz") > F.floor(F.col("top") / size)).join(seen, ["ix", "iy", "iz"], "left")
    over = over.groupBy("tree_id").agg(share(F.col("state") == "observed").alias("above_observed"))
    return out.join(over, "tree_id", "left")


def profile(grid: DataFrame, size: float, g: float = 0.5) -> DataFrame:
    """``iz, height, n, pad``: plant area density over a layer's observed voxels, from sums alone."""
    seen = grid.filter(F.col("rays") > 0).groupBy("iz").agg(F.count("*").alias("n"), F.sum("intercepted").alias("i"), F.sum("free_path").alias("f"))
    return seen.select("iz", ((F.col("iz") + 0.5) * size).alias("height"), "n", (ratio("i", "f") / g).alias("pad"))
