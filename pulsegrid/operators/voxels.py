"""Rays through voxels, and what they tell about each."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.cells import ratio

FIELDS = ("rays", "hits", "path", "free_path", "intercepted")
TRACED = T.StructType([T.StructField(c, T.LongType()) for c in ("ix", "iy", "iz")] + [T.StructField(c, T.DoubleType()) for c in FIELDS])


def crossings(origin: np.ndarray, end: np.ndarray, size: float, every: int = 1, within: tuple | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Voxels that segments cross: index of the segment, voxel, entry and exit along it.

    All segments are cut together where they meet grid planes; a piece's middle
    names its voxel.  ``every`` takes each so manieth plane only, and names blocks
    of so many voxels.  ``within``, a block's first voxel and its width, leaves out
    what lies elsewhere: cuts inside the block are the same numbers as without.
    """
    d = end - origin
    length = np.sqrt((d * d).sum(axis=1))
    cuts_i, cuts_t = [np.arange(len(d)), np.arange(len(d))], [np.zeros(len(d)), np.ones(len(d))]
    for a in range(3):
        lo, hi = np.minimum(origin[:, a], end[:, a]) / size, np.maximum(origin[:, a], end[:, a]) / size
        first, last = np.floor(lo / every).astype("i8") + 1, np.ceil(hi / every).astype("i8") - 1
        if within is not None:
            first, last = np.maximum(first, within[0][a]), np.minimum(last, within[0][a] + within[1])
        n = np.maximum(last - first + 1, 0)
        i = np.repeat(np.arange(len(d)), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        plane = (np.repeat(first, n) + step) * every * size
        cuts_i.append(i)
        cuts_t.append((plane - origin[i, a]) / d[i, a])
    i, t = np.concatenate(cuts_i), np.concatenate(cuts_t)
    order = np.lexsort([t, i])
    i, t = i[order], t[order]
    same = (i[1:] == i[:-1]) & (t[1:] > t[:-1])
    ray, enter, leave = i[:-1][same], t[:-1][same], t[1:][same]
    middle = origin[ray] + d[ray] * ((enter + leave) / 2)[:, None]
    voxel = np.floor(middle / size).astype("i8")
    if within is not None:
        own = ((voxel >= within[0]) & (voxel < np.asarray(within[0]) + within[1])).all(1)
        ray, voxel, enter, leave = ray[own], voxel[own], enter[own], leave[own]
    return ray, voxel // every, enter * length[ray], leave * length[ray]


def trace(rays: DataFrame, size: float) -> DataFrame:
    """Sums for each voxel that pulses cross.

    ``rays(ox, oy, oz, dx, dy, dz, reach, ranges)``: unit direction, the range to
    follow, and the ascending ranges of the echoes.  A pulse is followed to its
    last echo, or to ``reach`` if it has none.  Each batch is summed by voxel
    before it leaves the worker, so what is shuffled follows the voxels.
    """

    def run(batches):
        for batch in batches:
            step = 4096
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cols = {n: part.column(i) for i, n in enumerate(part.schema.names)}
                o = np.stack([cols[c].to_numpy(zero_copy_only=False) for c in ("ox", "oy", "oz")], 1).astype(float)
                d = np.stack([cols[c].to_numpy(zero_copy_only=False) for c in ("dx", "dy", "dz")], 1).astype(float)
                ranges = cols["ranges"].to_pylist()
                reach = np.array([r[-1] if r else x for r, x in zip(ranges, cols["reach"].to_pylist(), strict=True)], float)
                ray, voxel, enter, leave = crossings(o, o + d * reach[:, None], size)
                n_echo = np.array([len(r) for r in ranges])
                flat = np.array([x for r in ranges for x in r], float)
                owner = np.repeat(np.arange(len(ranges)), n_echo)
                hit_voxel = np.floor((o[owner] + d[owner] * np.nextafter(flat, 0)[:, None]) / size).astype("i8") if len(flat) else np.zeros((0, 3), "i8")
                first = np.array([r[0] if r else np.inf for r in ranges], float)
                free = np.clip(np.minimum(leave, first[ray]) - enter, 0, None)
                keys = np.concatenate([voxel, hit_voxel])
                values = np.zeros((len(keys), len(FIELDS)))
                values[: len(ray), [0, 2, 3]] = np.stack([np.ones(len(ray)), leave - enter, free], 1)
                values[len(ray) :, 1] = 1.0
                # a pulse is intercepted where its first echo lies
                values[len(ray) :, 4] = np.diff(owner, prepend=-1) != 0
                if not len(keys):
                    continue
                unique, where = np.unique(keys, axis=0, return_inverse=True)
                sums = np.zeros((len(unique), len(FIELDS)))
                np.add.at(sums, where.reshape(-1), values)
                arrays = [pa.array(unique[:, i]) for i in range(3)] + [pa.array(sums[:, i]) for i in range(len(FIELDS))]
                yield pa.RecordBatch.from_arrays(arrays, names=["ix", "iy", "iz", *FIELDS])

    cols = rays.select("ox", "oy", "oz", "dx", "dy", "dz", F.col("reach").cast("double").alias("reach"), F.col("ranges").cast("array<double>").alias("ranges"))
    return cols.mapInArrow(run, TRACED).groupBy("ix", "iy", "iz").agg(*[F.sum(f).alias(f) for f in FIELDS])


def merge(*grids: DataFrame) -> DataFrame:
    """Sum of voxel tables with one grid."""
    out = grids[0]
    for g in grids[1:]:
        out = out.unionByName(g)
    return out.groupBy("ix", "iy", "iz").agg(*[F.sum(f).alias(f) for f in FIELDS])


def densities(voxels: DataFrame, size: float, g: float = 0.5) -> DataFrame:
    """Attenuation and plant area density estimators for each voxel.

    ``contact`` is hits by free path, ``transmittance`` takes the share of rays
    let through and their mean chord; a voxel that lets none through keeps half
    a ray.  The unbiased form multiplies twice the hit rate by (n - 1) / n.
    """
    n = F.col("rays")
    chord = ratio("path", "rays")
    through = F.greatest(1 - F.col("intercepted") / n, 0.5 / n)
    return voxels.withColumns(
        {
            "contact": ratio("intercepted", "free_path"),
            "transmittance": F.when(chord > 0, -F.log(through) / chord),
            "pad": F.when(n > 1, ratio("intercepted", "free_path") / g),
            "pad_unbiased": F.when((n > 1) & (F.col("path") > 0), 2.0 * (n - 1) / n * F.col("hits") / F.col("path")),
        }
    )


def vertical_profile(voxels: DataFrame, size: float, value: str = "pad") -> DataFrame:
    """Mean over the observed voxels of each layer."""
    return voxels.groupBy("iz").agg(F.avg(value).alias(value), F.count(value).alias("n")).withColumn("height", (F.col("iz") + 0.5) * size)


def occlusion(voxels: DataFrame, box: tuple[int, int, int, int, int, int], least: float = 1.0) -> DataFrame:
    """By layer of a box of voxels: how many are observed by at least ``least`` rays."""
    x0, x1, y0, y1, z0, z1 = box
    inside = voxels.filter(F.col("ix").between(x0, x1) & F.col("iy").between(y0, y1) & F.col("iz").between(z0, z1) & (F.col("rays") >= least))
    whole = float((x1 - x0 + 1) * (y1 - y0 + 1))
    layers = voxels.sparkSession.range(z0, z1 + 1).select(F.col("id").alias("iz"))
    seen = inside.groupBy("iz").agg(F.count("*").alias("observed"))
    return layers.join(seen, "iz", "left").select("iz", F.coalesce("observed", F.lit(0)).alias("observed"), (1 - F.coalesce("observed", F.lit(0)) / whole).alias("occluded"))
