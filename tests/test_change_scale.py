from __future__ import annotations

import numpy as np
import pytest

from pulsegrid.operators import canopy, change, neighbours

C = "id long, x double, y double, z double, nx double, ny double, nz double"
P = "pid long, x double, y double, z double"


@pytest.mark.parametrize("depth", [0.4, 3.0, 7.3])
def test_cylinders_of_any_length_count_each_point_once(spark, depth):
    r = np.random.default_rng(8)
    n = r.standard_normal((6, 3))
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    cores = np.c_[r.uniform(-3, 3, (6, 3)), n]
    clouds = [r.uniform(-8, 8, (1500, 3)) for _ in "ab"]
    frames = [spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(c)], P) for c in clouds]
    got = {x.id: x for x in change.m3c2(spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cores)], C), *frames, 1.0, depth).collect()}
    for i, c in enumerate(cores):
        s = [(p - c[:3]) @ c[3:] for p in clouds]
        inside = [v[(np.abs(v) <= depth) & (((p - c[:3]) ** 2).sum(1) - v * v <= 1.0)] for v, p in zip(s, clouds, strict=True)]
        assert (got[i].na, got[i].nb) == (len(inside[0]), len(inside[1]))
        if len(inside[0]) and len(inside[1]):
            assert got[i].distance == pytest.approx(inside[1].mean() - inside[0].mean())


@pytest.mark.parametrize("origins", [3, 60])
def test_few_and_many_positions_agree(spark, origins):
    r = np.random.default_rng(9)
    o, p = r.uniform(0, 50, (origins, 3)), r.uniform(-10, 60, (300, 3))
    got = {x.pid: x.scan_id for x in canopy.scan_ids(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], P), spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(o)], "scan_id long, x double, y double, z double")).collect()}
    assert got == {i: int(((o - v) ** 2).sum(1).argmin()) for i, v in enumerate(p)}


def test_dense_cells_are_sorted_not_hashed(spark, monkeypatch):
    points = spark.createDataFrame([(i, 0.001 * (i % 50), 0.0, 0.0) for i in range(200)], P)
    hashed = neighbours.radius_outliers(points, 0.01)._jdf.queryExecution().toString()
    want = sorted(map(tuple, neighbours.count_within(points.withColumnRenamed("pid", "id"), points, 0.01, many=True).collect()))
    monkeypatch.setattr(neighbours, "HASHED_CELL", 10)
    again = neighbours.count_within(points.withColumnRenamed("pid", "id"), points, 0.01, many=True)
    assert "strategy=shuffle_hash" not in again._jdf.queryExecution().toString() and hashed
    assert sorted(map(tuple, again.collect())) == want


def test_points_on_the_rim_of_a_cylinder_count(spark):
    z = [i / 10 for i in range(-30, 31)]
    cloud = spark.createDataFrame([(i, 2.0, 0.0, v) for i, v in enumerate(z)], P)
    core = spark.createDataFrame([(1, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0)], C)
    got = change.m3c2(core, cloud, cloud, 2.0, 3.0).first()
    assert (got.na, got.nb) == (len(z), len(z))


@pytest.mark.parametrize("dims", [2, 3])
def test_nearest_of_dense_points_make_few_pairs(spark, monkeypatch, dims):
    r = np.random.default_rng(10)
    p = np.round(r.uniform(0, 1, (1500, 3)), 2)  # some at equal distances
    p[:5] += 3  # and some far from the others
    points = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], P).cache()
    pairs = []
    join = neighbours.radius_join

    def counted(*args, **kw):
        near = join(*args, **kw)
        pairs.append(near.count())
        return near

    monkeypatch.setattr(neighbours, "radius_join", counted)
    got = {}
    for x in neighbours.knn(points.withColumnRenamed("pid", "id"), points, 4, 2.0, 8.0, dims).collect():
        got.setdefault(x.id, {})[x["rank"]] = x.pid
    assert sum(pairs) < 60 * len(p)
    for i, v in enumerate(p):
        d2 = sum((p[:, a] - v[a]) * (p[:, a] - v[a]) for a in range(dims))
        assert [got[i][k] for k in range(1, 5)] == np.lexsort([np.arange(len(p)), d2])[:4].tolist()
