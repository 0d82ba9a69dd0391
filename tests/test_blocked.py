from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import blocked, trees, voxels


@pytest.fixture(scope="module")
def rays(spark):
    r = np.random.default_rng(2)
    rows = []
    for i in range(400):
        d = r.standard_normal(3)
        d /= np.linalg.norm(d)
        if i % 10 == 0:
            d = np.eye(3)[i // 10 % 3] * (1 if i % 20 else -1)  # along an axis, some on grid planes
        o = np.zeros(3) if i % 3 else np.round(r.uniform(-6, 6, 3))
        ranges = np.sort(r.uniform(0.5, 18, int(r.integers(0, 4)))).tolist()
        ranges += ranges[-1:] if i % 7 == 0 else []
        rows.append((*map(float, o), *map(float, d), 20.0, ranges))
    return spark.createDataFrame(rows, "ox double, oy double, oz double, dx double, dy double, dz double, reach double, ranges array<double>")


def sums(df, fields=voxels.FIELDS):
    return {(r.ix, r.iy, r.iz): tuple(round(r[f], 9) for f in fields) for r in df.collect() if any(r[f] for f in fields)}


@pytest.mark.parametrize(("size", "block"), [(0.5, 4), (0.3, 16), (1.0, 64)])
def test_blocks_sum_to_the_whole(rays, monkeypatch, size, block):
    monkeypatch.setattr(blocked, "PIECES", 50)  # the scanner's block is dealt out
    found = blocked.trace(rays, size, block).cache()
    assert sums(found) == sums(voxels.trace(rays, size))
    assert found.filter((F.floor(F.col("ix") / block) != F.col("bx")) | (F.floor(F.col("iz") / block) != F.col("bz"))).count() == 0
    # what lies beyond the last echo: as if those pulses had none, less what they did see
    end = F.element_at("ranges", -1)
    beyond = rays.filter(F.size("ranges") > 0).filter(end < F.col("reach"))
    moved = beyond.select(*[(F.col(f"o{c}") + F.col(f"d{c}") * end).alias(f"o{c}") for c in "xyz"], "dx", "dy", "dz", (F.col("reach") - end).alias("reach"), F.array().cast("array<double>").alias("ranges"))
    want = {k: v[0] for k, v in sums(voxels.trace(moved, size), ("rays",)).items()}
    got = {k: v[0] for k, v in sums(found, ("hidden",)).items()}
    assert sum(abs(want.get(k, 0) - got.get(k, 0)) for k in {*want, *got}) <= 0.002 * sum(want.values())  # ends are computed in two ways


def test_rays_along_the_side_of_a_block(spark):
    """Rounding takes such a ray to the other side on its way, where the block's own middle is not."""
    rows = []
    for y in (8.0, 16.0, 32.0, 64.0):
        for tilt in range(1, 30):
            for turn in (90, 180, 270, 360):
                u, v = np.radians(tilt), np.radians(turn)
                d = np.sin(u) * np.sin(v), np.sin(u) * np.cos(v), -np.cos(u)
                rows.append((y, y, 40.25, *map(float, d), 40.0, [25.0 + tilt / 7, 39.0]))
    held = spark.createDataFrame(rows, "ox double, oy double, oz double, dx double, dy double, dz double, reach double, ranges array<double>")
    assert sums(blocked.trace(held, 2.0, 4)) == sums(voxels.trace(held, 2.0))


def test_boxes_read_their_blocks(spark, rays, tmp_path):
    path = str(tmp_path / "g")
    found = blocked.trace(rays, 0.5, 8).cache()
    blocked.write(found, path)
    grid = blocked.open_grid(spark, path)
    assert sums(grid, blocked.ALL_FIELDS) == sums(found, blocked.ALL_FIELDS)
    box = (-3, 9, 0, 4, -20, -9)
    part = blocked.read_box(grid, box, 8)
    inside = found.filter("ix between -3 and 9 and iy between 0 and 4 and iz between -20 and -9")
    assert sums(part, blocked.ALL_FIELDS) == sums(inside, blocked.ALL_FIELDS)
    opened = {f.split("/g/")[1].rsplit("/", 1)[0] for f in part.select(F.input_file_name().alias("f")).distinct().toPandas().f}
    assert opened <= {f"bx={x}/by=0/bz={z}" for x in (-1, 0, 1) for z in (-3, -2)}
    plan = part._jdf.queryExecution().simpleString()
    assert "PartitionFilters: [isnotnull" in plan
    assert blocked.trace(rays.limit(0), 0.5, 8).count() == 0


def test_states_and_tree_sampling(spark):
    # pulses straight down onto a plate that hides what is below it
    rows = [(x + 0.5, y + 0.5, 20.0, 0.0, 0.0, -1.0, 20.0, [10.5] if x < 5 else []) for x in range(10) for y in range(10)]
    rays = spark.createDataFrame(rows, "ox double, oy double, oz double, dx double, dy double, dz double, reach double, ranges array<double>")
    grid = blocked.trace(rays, 1.0, 4)
    got = {(r.ix, r.iy, r.iz): r.state for r in blocked.states(grid).collect()}
    for x in range(10):
        for z in range(20):
            assert got[x, 0, z] == ("occluded" if x < 5 and z < 9 else "observed")
    r = np.random.default_rng(4)
    xyz = r.uniform([2, 2, 4], [8, 6, 12], (600, 3))
    points = spark.createDataFrame(pd.DataFrame({"x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "tree_id": 3})).unionByName(spark.createDataFrame([(0.0, 0.0, 0.0, -1), (30.5, 30.5, 3.5, 9)], "x double, y double, z double, tree_id long"))
    want = set()
    for iz in range(4, 12):
        own = xyz[np.floor(xyz[:, 2]) == iz][:, :2]
        ring = trees.hull(*(np.concatenate([own[:, a] + s for s in ((-0.5, 0.5, -0.5, 0.5) if a == 0 else (-0.5, -0.5, 0.5, 0.5))]) for a in (0, 1)))
        side = np.roll(ring, -1, 0) - ring
        for ix in range(12):
            for iy in range(12):
                c = np.array([ix + 0.5, iy + 0.5]) - ring
                if (side[:, 0] * c[:, 1] - side[:, 1] * c[:, 0] >= -1e-12).all():
                    want.add((ix, iy, iz))
    assert {(r.ix, r.iy, r.iz) for r in blocked.envelopes(points.filter("tree_id = 3"), 1.0).collect()} == want
    found = {r.tree_id: r for r in blocked.tree_sampling(grid, points, 1.0, least=1.0).collect()}
    t, state = found[3], [got.get(k, "unobserved") for k in want]
    assert set(found) == {3, 9} and t.n_voxels == len(want) and t.volume == len(want)
    for s in ("observed", "occluded", "unobserved"):
        assert t[s] == pytest.approx(state.count(s) / len(state))
    assert t.well_sampled == t.observed and t.above_observed == 1.0 and t.median_beams == np.median([s == "observed" for s in state])
    assert (found[9].unobserved, found[9].above_observed, found[9].n_voxels) == (1.0, 0.0, 1)
