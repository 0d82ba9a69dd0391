from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import targets, trees

T = "id long, x double, y double, z double"


def turned(r):
    q, _ = np.linalg.qr(r.standard_normal((3, 3)))
    q *= np.sign(np.linalg.det(q))
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = q, r.uniform(-30, 30, 3)
    return m


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_meet_without_a_first_guess(spark, seed):
    r = np.random.default_rng(seed)
    xyz = r.uniform([0, 0, 0], [40, 40, 4], (30, 3))
    m = turned(r)
    b = xyz[4:] @ m[:3, :3].T + m[:3, 3] + r.normal(0, 0.003, (26, 3))
    strays = r.uniform(-20, 20, (8, 3))
    one = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)] + [(99, None, 1.0, 1.0)], T)
    two = spark.createDataFrame([(100 + i, *map(float, p)) for i, p in enumerate(b)] + [(500 + i, *map(float, p)) for i, p in enumerate(strays)], T)
    got, pairs = targets.match_targets(one, two)
    assert {(p.id_a, p.id_b) for p in pairs.collect()} == {(i, 96 + i) for i in range(4, 30)}
    assert np.abs(got - m).max() < 0.02 and targets.residual(pairs) < 0.01


def test_strangers_do_not_match(spark):
    r = np.random.default_rng(5)
    one, two = (spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(r.uniform(0, 40, (12, 3)))], T) for _ in range(2))
    m, pairs = targets.match_targets(one, two, 0.02, 0.005, least=5)
    assert m is None and pairs.count() == 0
    assert targets.match_targets(one.limit(0), two)[0] is None and targets.match_targets(one, two.limit(0))[0] is None


def test_long_chains_are_settled_tile_by_tile(spark, monkeypatch):
    monkeypatch.setattr(trees, "PRUNE_TILE", 40)
    r = np.random.default_rng(6)
    rows = [(i, i * 0.0097, 0.0, 0.0) for i in range(600)] + [(600 + i, *map(float, p)) for i, p in enumerate(r.uniform([0, 1, 0], [6, 3, 1], (300, 3)))]
    got = {p.pid for p in trees.min_distance_subsample(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 0.1).collect()}
    xyz, kept = np.array([p[1:] for p in rows]), []
    for i in range(len(rows)):
        if not kept or ((xyz[kept] - xyz[i]) ** 2).sum(1).min() > 0.01:
            kept.append(i)
    assert got == set(kept)
    found = spark.createDataFrame([(i, float(x), 0.0, int(n)) for i, (x, n) in enumerate(zip(np.linspace(0, 50, 200), r.integers(0, 9, 200), strict=True))], "tree_id long, x double, y double, n_points long")
    stays: dict[int, bool] = {}
    for t in sorted(found.collect(), key=lambda t: (-t.n_points, t.tree_id)):
        stays[t.tree_id] = not any(v and abs(50 * (o - t.tree_id) / 199) <= 0.6 for o, v in stays.items())
    assert {t.tree_id for t in trees.prune(found, 0.6).select(F.col("tree_id")).collect()} == {i for i, v in stays.items() if v}
