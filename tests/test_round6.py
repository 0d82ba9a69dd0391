"""What the findings of the fourth round named: stem maps whose stems stand several times, neighbours and pairs at size."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import change, fit, graph, metrics, nearby, neighbours, points, scans, trees


def frame(spark, xyz, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **more}))


def test_stems_of_one_place_each_have_their_partner(spark):
    r = np.random.default_rng(11)
    at, dbh = np.tile(r.uniform(0, 60, (40, 2)), (3, 1)), np.tile(r.uniform(0.1, 0.9, 40), 3)
    a = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "x": at[:, 0], "y": at[:, 1], "z": 0.0, "dbh": dbh}))
    m = points.translation(7.0, -3.0, 0.0) @ points.rotation_z(40.0)
    b = points.transform(a.filter("id % 7 <> 0"), m)
    _, pairs = scans.match_stem_maps(a, b, 0.05, 0.01, 1.0, 25.0)
    assert sorted((p.id_a, p.id_b) for p in pairs.collect()) == [(i, i) for i in range(120) if i % 7]
    # without an id in common a place's stems meet in their order, as many as both maps have
    _, pairs = scans.match_stem_maps(a, b.withColumn("id", F.col("id") + 1000), 0.05, 0.01, 1.0, 25.0)
    want = []
    for k in range(40):
        here = [i for i in range(k, 120, 40) if i % 7]
        want += list(zip(range(k, 120, 40), [i + 1000 for i in here]))
    assert sorted((p.id_a, p.id_b) for p in pairs.collect()) == sorted(want)


def nearest_of(at, i, k, limit):
    """The k nearest points by distance, then number."""
    d2 = ((at - at[i]) ** 2).sum(axis=1)
    order = np.lexsort((np.arange(len(at)), d2))[:k]
    return order[d2[order] <= limit * limit]


@pytest.mark.parametrize("size", [30, 100_000])
def test_neighbours_of_tiles_agree_with_all_points(spark, monkeypatch, size):
    monkeypatch.setattr(nearby, "TILE_POINTS", size)
    monkeypatch.setattr(nearby, "LOOKED", 500)
    r = np.random.default_rng(3)
    # places on a grid, so that distances tie, most of them twice; a dense corner, and two points far off
    at = np.r_[np.repeat(r.integers(0, 40, (150, 3)) / 4, 2, axis=0), r.uniform(0, 0.5, (150, 3)), [[60.0, 60, 0], [300.0, 0, 0]]]
    at = at[r.permutation(len(at))]
    df = frame(spark, at).withColumn("x", F.when(F.col("pid") == 7, float("nan")).otherwise(F.col("x")))
    at = np.where(np.arange(len(at))[:, None] == 7, 1e9, at)
    k, limit = 6, 70.0
    got = {p.pid: p for p in neighbours.shape(df, k, 1.0, limit).collect()}
    far = {p.pid: p for p in neighbours.statistical_outliers(df, k, 2.0, 1.0, limit).select("pid", "mean_distance").collect()}
    for i in range(len(at)):
        near = nearest_of(at, i, k, limit) if i != 7 else []
        assert (i in got) == (len(near) >= 3)
        if i in got:
            values = np.linalg.eigvalsh(np.cov(at[near].T, bias=True))
            assert got[i].planarity == pytest.approx((values[1] - values[0]) / values[2] if values[2] > 1e-12 else 0.0, abs=1e-6)
            assert got[i].linearity == pytest.approx((values[2] - values[1]) / values[2] if values[2] > 1e-12 else 0.0, abs=1e-6)
        d = np.sqrt(((at - at[i]) ** 2).sum(axis=1))
        others = np.sort(np.delete(d, i))[:k]
        others = others[others <= limit]
        assert far[i].mean_distance == (pytest.approx(others.mean()) if len(others) else None)


def test_neighbours_of_a_dense_cloud_make_no_pairs(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "radius_join", lambda *args, **more: pytest.fail("pairs"))
    monkeypatch.setattr(nearby, "MARGIN", 2.0)
    df = frame(spark, np.random.default_rng(5).uniform(0, 4, (4000, 3)))
    assert neighbours.shape(df, 8, 1.0, 50.0).count() == neighbours.statistical_outliers(df, 8).filter("mean_distance > 0").count() == 4000


def test_thinning_in_shares_agrees_with_one_point_after_another(spark, monkeypatch):
    monkeypatch.setattr(trees, "FIRST_THINNED", 60)
    monkeypatch.setattr(graph, "tiled_points", lambda p, d, f=graph.tiled_points: f(p, d, 40))
    held = []
    monkeypatch.setattr(trees, "thinned", lambda p, d, f=trees.thinned: (held.append(p.count()), f(p, d))[1])
    r = np.random.default_rng(9)
    at = np.r_[r.integers(0, 60, (900, 3)) / 10, np.repeat(r.uniform(0, 6, (20, 3)), 15, axis=0)]
    at = at[r.permutation(len(at))]
    at[17] = np.nan
    kept = []
    for i, p in enumerate(at):
        if not any(((at[k] - p) ** 2).sum() < 1.0 for k in kept):
            kept.append(i)
    got = trees.min_distance_subsample(frame(spark, at), 1.0)
    assert sorted(p.pid for p in got.collect()) == kept
    # what stands near a kept point is never asked
    assert len(held) > 3 and sum(held) < 400


@pytest.mark.parametrize("size", [20, 100_000])
def test_cylinders_of_cores_make_no_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(change, "CLOUD_TILE", size)
    monkeypatch.setattr(nearby, "FULLEST", 1)
    monkeypatch.setattr(neighbours, "radius_join", lambda *args, **more: pytest.fail("pairs"))
    r = np.random.default_rng(2)
    clouds = [r.uniform(-6, 6, (700, 3)) for _ in "ab"]
    n = r.normal(size=(5, 3))
    cores = np.tile(np.c_[r.uniform(-3, 3, (5, 3)), n / np.linalg.norm(n, axis=1, keepdims=True)], (3, 1))
    cores = np.r_[cores, [[50, 50, 0, 0, 0, 1]]]
    rows = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(cores)], "id long, x double, y double, z double, nx double, ny double, nz double")
    got = {x.id: x for x in change.m3c2(rows, *[frame(spark, c) for c in clouds], 1.5, 4.0).collect()}
    assert len(got) == 16 and (got[15].na, got[15].nb, got[15].distance, got[15].significant) == (0, 0, None, False)
    for i, c in enumerate(cores[:15]):
        s = [(p - c[:3]) @ c[3:] for p in clouds]
        a, b = (v[(np.abs(v) <= 4.0) & (((p - c[:3]) ** 2).sum(1) - v * v <= 2.25)] for v, p in zip(s, clouds))
        assert (got[i].na, got[i].nb) == (len(a), len(b)) and min(len(a), len(b)) > 4
        assert got[i].distance == pytest.approx(b.mean() - a.mean())
        assert got[i].lod == pytest.approx(1.96 * np.sqrt(a.var(ddof=1) / len(a) + b.var(ddof=1) / len(b)))


@pytest.mark.parametrize("size", [20, 100_000])
def test_plots_count_heights_and_make_no_pairs(spark, monkeypatch, size):
    monkeypatch.setattr(metrics, "PLOT_TILE", size)
    monkeypatch.setattr(nearby, "FULLEST", 1)
    r = np.random.default_rng(8)
    n = 900
    cloud = frame(spark, np.c_[r.uniform(0, 12, (n, 2)), r.integers(-20, 200, n) / 10], intensity=r.integers(0, 9, n), return_number=r.integers(1, 8, n), classification=r.integers(1, 9, n))
    cloud = cloud.union(frame(spark, np.array([[30.0, 30, 1.5], [40.0, 40, 0], [40.0, 40, 0]]), intensity=[4, 5, 5], return_number=[2, 1, 1], classification=[1, 1, 1]))
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 12, (7, 2)))] + [(7, 30.0, 30.0), (8, 40.0, 40.0), (9, 90.0, 90.0), (10, None, 1.0)]
    plots = spark.createDataFrame(rows, "id long, x double, y double")
    want = metrics.metrics(metrics.plot_points(cloud, plots, 2.5), ["id"], least=-1.5, threshold=1.0).toPandas().sort_values("id").reset_index(drop=True)
    monkeypatch.setattr(neighbours, "radius_join", lambda *args, **more: pytest.fail("pairs"))
    for q in (plots, plots.union(plots.withColumn("id", F.col("id") + 20))):
        df = metrics.plot_metrics(cloud, q, 2.5, least=-1.5, threshold=1.0)
        got = df.toPandas().sort_values("id").reset_index(drop=True)
        assert list(got.columns) == list(want.columns) and len(want) == 9
        for k in range(0, len(got), 9):
            pd.testing.assert_frame_equal(got.iloc[k : k + 9, 1:].reset_index(drop=True).astype(float), want.iloc[:, 1:].astype(float), rtol=1e-9, atol=1e-9)


def test_registrations_pair_in_tiles_that_are_dealt_once(spark, monkeypatch):
    r = np.random.default_rng(1)
    xyz = np.round(r.uniform(0, 9, (700, 3)), 2)
    xyz = np.r_[xyz, xyz[:300]]
    n = r.normal(size=(1000, 3))
    n[700:] = n[:300]
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    target = frame(spark, xyz, **{f"n{c}": n[:, i] for i, c in enumerate("xyz")})
    source = frame(spark, xyz[::-1] + [0.004, -0.003, 0.002])
    # a pid that stands twice counts once, with the nearer of its places
    again = source.filter("pid < 3").withColumn("x", F.col("x") + 0.01)
    got = scans.evaluate_registration(source.union(again), target, np.eye(4), 0.05).first()
    assert (got.n_inliers, got.fitness) == (1000, pytest.approx(1000 / 1003)) and got.inlier_rmse == pytest.approx(29e-6**0.5)
    dealt = []
    monkeypatch.setattr(scans, "closest", lambda *args, **more: pytest.fail("pairs"))
    monkeypatch.setattr(scans, "icp_tiles", lambda *args, f=scans.icp_tiles: (dealt.append(1), f(*args))[1])
    m, _, rounds = scans.plane_icp(source, target, 0.05)
    assert rounds > 1 and len(dealt) == 1 and np.abs(m[:3, 3] - [-0.004, 0.003, -0.002]).max() < 1e-6
    tiles = fit.icp_tiles(source, target, np.eye(4), 0.1)
    rounds_plan = fit.paired(tiles.sparkSession.createDataFrame(tiles.collect(), tiles.schema), np.eye(4), 0.05, np.zeros(3), True)._jdf.queryExecution().toString()
    assert "Exchange" not in rounds_plan and sum(len(t.n) for t in tiles.collect()) == 700


@pytest.mark.parametrize("copies", [1, 4])
def test_paths_of_copies_run_over_places(spark, copies):
    r = np.random.default_rng(6)
    at = np.tile(np.r_[r.integers(0, 24, (60, 3)) / 4, [[20, 0, 0]]], (copies, 1))
    at = np.r_[at, at[:5], [[np.nan, 0, 0], [np.nan, 0, 0]]]
    # some places have sources among their copies only, and one point without a place is a source
    sources = sorted({i for i in range(len(at)) if i % 17 == 3} | {1, 61 * copies + 1, len(at) - 1})
    d = np.sqrt(((at[:, None] - at[None]) ** 2).sum(axis=2))
    near = (d <= 1.5) & ~np.eye(len(at), dtype=bool)
    label = {i: (0.0, i) for i in sources}
    while True:
        new = dict(label)
        for i, (far, s) in label.items():
            for j in np.flatnonzero(near[i]):
                new[j] = min(new.get(j, (np.inf, 0)), (far + d[i, j], s))
        if new == label:
            break
        label = new
    got = graph.near_paths(frame(spark, at), 1.5, spark.createDataFrame([(i,) for i in sources], "pid long")).collect()
    assert sorted(p.pid for p in got) == list(range(len(at)))
    for p in got:
        assert (p.dist, p.source) == label.get(p.pid, (None, None))
        prior = [i for i in np.flatnonzero(near[p.pid]) if d[i, p.pid] > 0 and i in label and label[p.pid] == (label[i][0] + d[i, p.pid], label[i][1])] if p.pid in label else []
        # a source is its own, and what else stands at its place hangs on it
        assert p.pred == (min(prior, default=p.pid if p.pid in sources else label[p.pid][1]) if p.pid in label else None)


def test_a_pid_at_two_places_has_a_row_for_each(spark):
    rows = [(i, float(i // 3), 0.0, 0.0) for i in range(12)] + [(9, 50.0, 0.0, 0.0)]
    got = graph.near_paths(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 1.0, spark.createDataFrame([(0,)], "pid long")).collect()
    assert len(got) == 13 and sorted(p.dist for p in got if p.pid == 9) == [3.0, 3.0]
