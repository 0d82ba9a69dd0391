"""Cases of the round's findings: work that grew with density, copies or wide groups."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import graph, metrics, neighbours, scans, surface, trees


def test_wide_trees_are_left_whole(spark):
    """a tree of few places in each block makes no group a block; a dense one is cut into blocks."""
    r = np.random.default_rng(3)
    wide = [(1, float(x), float(y)) for x, y in r.uniform(0, 40, (640, 2))]
    dense = [(2, float(x), float(y)) for x, y in r.uniform(0, 10, (640, 2))]
    df = spark.createDataFrame(wide + dense, "tree_id long, x double, y double")
    got = trees.hull_corners(df, "tree_id").toPandas()
    held = {k: g for k, g in got.groupby("tree_id")}
    assert len(held[1]) == len(wide) and len(held[2]) < len(dense) / 2
    assert len(trees.hull_corners(df, "tree_id", spots=100).filter("tree_id = 1").toPandas()) < len(wide)
    for k, rows in ((1, wide), (2, dense)):
        x, y = np.array([v[1:] for v in rows]).T
        assert trees.hull_area(held[k]["x"].to_numpy(), held[k]["y"].to_numpy()) == pytest.approx(trees.hull_area(x, y))


def test_chance_of_many_pulses(monkeypatch):
    """chances end where they are known, and steps of any size give the same."""

    def plain(n_a, n_b, m, alpha):
        a = b = 1.0
        p = need = None
        for i in range(1, n_a + n_b + 1):
            a *= max(n_a - i + 1, 0) / (n_a + n_b - i + 1)
            b *= max(n_b - i + 1, 0) / (n_a + n_b - i + 1)
            p = a + b if i == m else p
            need = i if need is None and a + b <= alpha else need
        return p, need

    cases = [(5, 7, 2), (1, 1, 1), (1, 90, 60), (90, 1, 91), (40, 40, 0), (300, 2, 290)]
    want = [plain(*c, 0.05) for c in cases]
    for step in (1, 7, surface.STEP):
        monkeypatch.setattr(surface, "STEP", step)
        for c, (p, need) in zip(cases, want, strict=True):
            got = surface.chance(*c, 0.05)
            assert got[1] == need and (got[0] is None if p is None else got[0] == pytest.approx(p, abs=1e-12))
    assert surface.chance(10**9, 10**9, 3, 0.05) == (pytest.approx(0.25), 6)


def test_places_share_their_neighbours(spark, monkeypatch):
    """queries of one place are searched once and all answered, also by those without a place."""
    r = np.random.default_rng(5)
    p = spark.createDataFrame([(i, float(x), float(y), float(z), int(i % 3)) for i, (x, y, z) in enumerate(r.uniform(0, 10, (800, 3)))], "pid long, x double, y double, z double, label int").cache()
    spots = r.uniform(2, 8, (6, 2))
    rows = [(i, float(spots[i % 6, 0]), float(spots[i % 6, 1])) for i in range(40)] + [(90, None, 1.0), (91, None, 1.0)]
    q = spark.createDataFrame(rows, "id long, x double, y double")
    assert neighbours.places(q, ("x", "y"))[0].count() == 7
    assert neighbours.places(q.limit(6), ("x", "y")) is None
    stems = q.withColumnRenamed("id", "stem")
    runs = {
        "count": lambda: neighbours.count_within(q, p, 1.5, dims=2),
        "knn": lambda: neighbours.knn(q.filter("x is not null"), p, 4, 0.5, 50.0, dims=2),
        "majority": lambda: neighbours.majority(q, p, "label", dims=2),
        "plots": lambda: metrics.plot_metrics(p, q, 3.0),
        "taper": lambda: trees.dbh_profile(p, stems, 0.5, 0.2, 3.0),
        "noise": lambda: scans.stem_noise(p, stems, high=8.0, search=3.0),
    }
    shared = {k: f().toPandas() for k, f in runs.items()}
    monkeypatch.setattr(neighbours, "places", lambda *a: None)
    monkeypatch.setattr(scans, "places", lambda *a: None)
    for k, f in runs.items():
        got, want = (d.sort_values(list(d.columns[:2])).reset_index(drop=True) for d in (shared[k], f().toPandas()))
        assert len(want) >= 40 and list(got.columns) == list(want.columns), k
        for c in want.columns:
            assert got[c].to_numpy(float) == pytest.approx(want[c].to_numpy(float), rel=1e-9, abs=1e-9, nan_ok=True), (k, c)


def test_circles_from_one_pass(spark):
    """sums about a known place give the circle of sums about the mean, and none for points in one line."""
    r = np.random.default_rng(6)
    rows = [(k, float(x), float(y), 500.0, 900.0) for k in range(5) for x, y in np.array([500.0, 900.0]) + r.normal(0, 2, (9, 2))]
    rows += [(9, 500.0 + t / 7, 900.0 + t / 3, 500.0, 900.0) for t in range(8)]
    df = spark.createDataFrame(rows, "k long, x double, y double, x0 double, y0 double")
    got = trees.circle_fit_at(df, ["k"], "x0", "y0").toPandas().sort_values("k").to_numpy(float)
    want = trees.circle_fit(df, "k").toPandas().sort_values("k").to_numpy(float)
    assert got[:5] == pytest.approx(want[:5], rel=1e-7) and np.isnan(got[5, 2:]).all()
    plan = trees.dbh_profile(df.select("x", "y", "x0", F.lit(0.0).alias("z")), df.selectExpr("k as stem", "x", "y").limit(3))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # the pairs are met once and not joined to their means


def test_closest_widens_only_where_nothing_is_near(spark, monkeypatch):
    """a dense cloud is met in a small ball first; what is far, equal or twice there comes out as before."""
    r = np.random.default_rng(10)
    b = np.round(r.uniform(0, 2, (3000, 3)), 2)
    a = np.concatenate([np.round(r.uniform(0, 2, (200, 3)), 2), [[2.7, 1, 1], [9, 9, 9]]])
    frame = lambda v: spark.createDataFrame([(i, *map(float, w)) for i, w in enumerate(v)], "pid long, x double, y double, z double")
    source = frame(a).union(frame([[50, 50, 50]]))  # pid 0 stands twice
    radii = []
    join = neighbours.radius_join
    monkeypatch.setattr(neighbours, "radius_join", lambda q, p, radius, *args, **k: radii.append(radius) or join(q, p, radius, *args, **k))
    got = {x.id: x for x in scans.closest(source, frame(b), np.eye(4), 1.0).collect()}
    d2 = ((a[:, None] - b[None]) ** 2).sum(2)
    best = [min((d, k) for k, d in enumerate(row)) for row in d2.round(12)]
    assert sorted(got) == [i for i, (d, _) in enumerate(best) if d <= 1.0] and 200 in got
    assert all(got[i].d2 == pytest.approx(best[i][0], abs=1e-9) and got[i].px == pytest.approx(a[i, 0]) for i in got)
    assert radii[0] < 0.3 and radii[-1] == 1.0


def test_clusters_of_dense_and_mixed_places(spark, monkeypatch):
    """groups that no two points can part are not paired; all others are linked as by brute force."""
    r = np.random.default_rng(9)
    p = np.concatenate([r.uniform(0, 3, (900, 3)), r.uniform(-9, 9, (300, 3)), [[20 + 0.9 * i, 0, 0] for i in range(9)], [[20, 5, 0], [21.01, 5, 0]]])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)], "pid long, x double, y double, z double")
    label = np.arange(len(p))
    near = ((p[:, None] - p[None]) ** 2).sum(2) <= 1.0
    while True:
        new = np.where(near, label[None], len(p)).min(1)
        if (new == label).all():
            break
        label = new
    want = np.where(np.bincount(label, minlength=len(p))[label] >= 3, label, -1)
    got = {x.pid: x.cluster for x in graph.clusters(df, 1.0, 3).collect()}
    assert [got[i] for i in range(len(p))] == want.tolist()
    asked = []
    join = graph.radius_join
    monkeypatch.setattr(graph, "radius_join", lambda q, *a, **k: asked.append(q.count()) or join(q, *a, **k))
    full = spark.range(20_000).selectExpr("id as pid", "(id % 20) * 0.1 as x", "(id div 20 % 20) * 0.1 as y", "(id div 400) * 0.02 as z")
    assert [x["count"] for x in graph.clusters(full, 1.0, 3).groupBy("cluster").count().collect()] == [20_000] and asked == [0]
