from __future__ import annotations

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.cells import compare
from pulsegrid.operators import fit, graph, ground, metrics, neighbours, points, pulses, raster, trees, voxels

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def cloud(spark):
    r = np.random.default_rng(1)
    n = 1500
    xyz = r.uniform(0, 10, (n, 3))
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "label": np.arange(n) % 3})).repartition(4), xyz


def rows(df, key="pid"):
    return {r[key]: r for r in df.collect()}


def test_nan_compares_as_ieee(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (1.0, 2.0)], "a double, b double")
    got = [tuple(r) for r in df.select(compare("a", "<", "b"), compare("a", "!=", "b"), compare("b", ">", "a")).collect()]
    assert got == [(False, True, False), (True, True, True)]


def test_crops_and_thinning(cloud):
    df, xyz = cloud
    inside = ((xyz >= [2, 2, 0]) & (xyz <= [5, 9, 4])).all(axis=1)
    assert points.crop_box(df, (2, 2, None), (5, 9, 4)).count() == inside.sum()
    assert points.crop_box(df, (2, 2, None), (5, 9, 4), invert=True).count() == (~inside).sum()
    first = {}
    for i, v in enumerate(map(tuple, np.floor(xyz / 2.5).astype(int))):
        first.setdefault(v, i)
    assert sorted(rows(points.voxel_first(df, 2.5))) == sorted(first.values())
    assert points.random_points(df, 100, 3).count() == 100
    kept = points.decimate_random(df, 0.25, 5.0).withColumns({"tx": F.floor(F.col("x") / 5), "ty": F.floor(F.col("y") / 5)}).groupBy("tx", "ty").count().collect()
    tiles = pd.DataFrame(np.floor(xyz[:, :2] / 5)).value_counts()
    assert {(r.tx, r.ty): r["count"] for r in kept} == {(int(a), int(b)): round(0.25 * n + 1e-9) for (a, b), n in tiles.items()}


def test_results_do_not_depend_on_partitions(spark, cloud):
    df, _ = cloud
    one = metrics.grid_metrics(df.repartition(1), 5.0).toPandas().sort_values(["row", "col"]).reset_index(drop=True)
    many = metrics.grid_metrics(df.repartition(13), 5.0).toPandas().sort_values(["row", "col"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(one, many, rtol=1e-9)


def test_metric_edge_rules(spark):
    def of(heights):
        df = spark.createDataFrame([(i, float(h)) for i, h in enumerate(heights)], "pid long, z double")
        return metrics.metrics(df, []).first()

    m = of(range(11))
    assert m.n == 11 and m.zmax == 10 and m.zskew == pytest.approx(0, abs=1e-12) and m.zkurt == pytest.approx(1.78)
    assert [m[f"zpcum{k}"] for k in range(1, 10)] == pytest.approx([10.0 * k for k in range(1, 10)])
    assert of([0.1, 1.9]).zentropy is None and of([-0.1, 5]).zentropy is None
    assert of([3.0]).zsd is None
    assert metrics.metric_names()[:4] == ["n", "zmax", "zmean", "zsd"]


def test_knn_and_outliers(cloud):
    df, xyz = cloud
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1))
    q = df.filter("pid < 60").select(F.col("pid").alias("id"), "x", "y", "z")
    got = {}
    for r in neighbours.knn(q, df, 5, 0.3, 50.0).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.pid
    for i in range(60):
        assert [got[i][k] for k in range(1, 6)] == np.lexsort([np.arange(len(d)), d[i]])[:5].tolist()
    mean = np.sort(d, axis=1)[:, 1:5].mean(axis=1)
    keep = mean <= mean.mean() + 1.5 * mean.std()
    assert {k: r.keep for k, r in rows(neighbours.statistical_outliers(df, 4, 1.5, start=0.5, limit=50.0)).items()} == dict(enumerate(keep.tolist()))
    ror = rows(neighbours.radius_outliers(df, 1.0, 6))
    assert {k: r.keep for k, r in ror.items()} == dict(enumerate(((d <= 1.0).sum(1) - 1 >= 6).tolist()))


def test_knn_beyond_the_limit_gives_what_there_is(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, 1.0, 0.0, 0.0), (3, 50.0, 0.0, 0.0)], "pid long, x double, y double, z double")
    q = spark.createDataFrame([(9, 0.2, 0.0, 0.0), (8, 500.0, 0.0, 0.0)], "id long, x double, y double, z double")
    assert sorted((r.id, r.pid) for r in neighbours.knn(q, df, 3, 0.5, 10.0).collect()) == [(9, 1), (9, 2)]
    assert rows(neighbours.nearest(q, df, 1.0, 10.0), "id")[8].pid is None


def test_shape_of_a_plane(spark):
    r = np.random.default_rng(2)
    xy = r.uniform(0, 5, (300, 2))
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(300), "x": xy[:, 0], "y": xy[:, 1], "z": 0.1 * xy[:, 0]}))
    got = neighbours.shape(df, 12, 0.5, 20.0).agg(F.min("planarity"), F.avg("nz"), F.avg("nx")).first()
    n = np.array([-0.1, 0, 1]) / math.sqrt(1.01)
    assert got[0] >= 0 and got[1] == pytest.approx(n[2], abs=1e-6) and got[2] == pytest.approx(n[0], abs=1e-6)


def test_raster_fill_and_bilinear(spark):
    r = spark.createDataFrame([(0, 0, 1.0), (0, 4, 5.0), (4, 0, 9.0)], "row long, col long, value double")
    full = {(x.row, x.col): x.value for x in raster.fill_nearest(r, range(5), range(5)).collect()}
    assert len(full) == 25 and full[0, 1] == 1.0 and full[0, 3] == 5.0 and full[3, 0] == 9.0 and full[0, 2] == 1.0
    grid = spark.createDataFrame([(i, j, float(i * 10 + j)) for i in range(4) for j in range(4)], "row long, col long, value double")
    p = spark.createDataFrame([(1, 1.5, 1.5), (2, 2.0, 1.5), (3, -3.0, 9.0), (4, 1.25, 2.75)], "pid long, x double, y double")
    got = {k: r.ground for k, r in rows(raster.bilinear(p, grid, 1.0)).items()}
    assert got == pytest.approx({1: 11.0, 2: 11.5, 3: 30.0, 4: 0.75 + 22.5})


def test_ground_filters_on_a_slope(spark):
    r = np.random.default_rng(3)
    xy = r.uniform(0, 20, (6000, 2))
    z = 0.05 * xy[:, 0] + r.normal(0, 0.01, 6000)
    high = np.arange(6000) % 4 == 0
    z = z + np.where(high, r.uniform(2, 10, 6000), 0)
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(6000), "x": xy[:, 0], "y": xy[:, 1], "z": z, "high": high}))
    for got in (ground.progressive_morphology(df, 0.5), ground.cloth_simulation(df, 0.5, tile=10.0, buffer=5.0)):
        t = got.groupBy("high").agg(F.avg(F.col("ground").cast("int")).alias("share")).collect()
        share = {x.high: x.share for x in t}
        assert share[False] > 0.97 and share[True] < 0.02
    dtm = ground.terrain(df.filter("not high"), 0.5)
    h = ground.heights(df, dtm, 0.5).groupBy("high").agg(F.max(F.abs("height")).alias("m"), F.min("height").alias("low")).collect()
    assert {x.high: x for x in h}[False].m < 0.2 and {x.high: x for x in h}[True].low > 1.5


def test_clusters_and_paths(spark):
    xs = [0.0, 0.8, 1.6, 5.0, 5.5, 20.0]
    df = spark.createDataFrame([(i, x, 0.0, 0.0) for i, x in enumerate(xs)], "pid long, x double, y double, z double")
    assert {k: r.cluster for k, r in rows(graph.clusters(df, 1.0, 2)).items()} == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: -1}
    edges = graph.radius_graph(df, 3.5)
    got = rows(graph.shortest_paths(df, edges, spark.createDataFrame([(0,)], "pid long")))
    assert got[4].dist == pytest.approx(5.5) and got[4].source == 0 and got[5].dist is None
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "src long, dst long")
    assert graph.components(spark.range(201).withColumnRenamed("id", "pid"), chain).select("component").distinct().count() == 1


def test_pulses(spark):
    t = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 10.0), ("a", 100.0, 0.0)], "k string, t double, x double")
    q = spark.createDataFrame([(1, "a", 2.5), (2, "a", 50.0), (3, "a", -1.0), (4, "a", 10.0)], "id long, k string, t double")
    got = {r.id: r.x for r in pulses.interpolate_track(q, t, "k", 20.0, ("x",)).collect()}
    assert got == {1: 2.5, 2: None, 3: None, 4: 10.0}
    miss = pulses.missing_pulses(spark.createDataFrame([("a", x) for x in (0.0, 1.0, 4.0, 5.0)], "k string, t double"), "k", "t", 1.0, 10).collect()
    assert sorted(r.t for r in miss) == [2.0, 3.0]
    d = spark.range(1).select(*[v.alias(k) for k, v in pulses.direction(F.lit(90.0), F.lit(90.0)).items()]).first()
    assert (d.dx, d.dy, d.dz) == pytest.approx((1, 0, 0), abs=1e-12)


def test_rays_cross_voxels(spark):
    ray, voxel, enter, leave = voxels.crossings(np.array([[0.5, 0.5, 0.5]]), np.array([[3.5, 0.5, 0.5]]), 1.0)
    assert voxel[:, 0].tolist() == [0, 1, 2, 3] and (leave - enter).sum() == pytest.approx(3.0)
    s = math.sqrt(0.5)
    df = spark.createDataFrame([(0.5, 0.2, 0.5, s, s, 0.0, 10.0, [2.0]), (0.5, 0.2, 0.5, 1.0, 0.0, 0.0, 2.0, [])], "ox double, oy double, oz double, dx double, dy double, dz double, reach double, ranges array<double>")
    got = voxels.trace(df, 1.0)
    assert got.agg(F.sum("path")).first()[0] == pytest.approx(4.0) and got.agg(F.sum("hits"), F.sum("intercepted")).first() == (1.0, 1.0)
    twice = voxels.merge(got, got).agg(F.sum("path")).first()[0]
    assert twice == pytest.approx(8.0)


def test_trees(spark):
    r = np.random.default_rng(4)
    out = []
    for k, (cx, cy) in enumerate([(3.0, 3.0), (8.0, 8.0)]):
        a, h = r.uniform(0, 2 * np.pi, 6000), r.uniform(0.9, 5.0, 6000)
        rad = 0.15 + 0.05 * k + r.normal(0, 0.003, 6000)
        out.append(np.stack([cx + rad * np.cos(a), cy + rad * np.sin(a), h], 1))
    p = np.concatenate(out)
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2]}))
    got = sorted((r.x, r.y, r.dbh) for r in trees.stems(trees.stem_slices(df)).collect())
    assert [v for t in got for v in t] == pytest.approx([3.0, 3.0, 0.30, 8.0, 8.0, 0.40], abs=0.02)
    assert trees.hull_area(np.array([0, 1, 1, 0, 0.5]), np.array([0, 0, 1, 1, 0.5])) == 1.0
    canopy = spark.createDataFrame([(i, j, 12 - math.hypot(i - 5, j - 5) if j < 12 else 10 - math.hypot(i - 5, j - 17)) for i in range(11) for j in range(24)], "row long, col long, value double")
    tops = trees.tree_tops(canopy, 1.0, 5.0, 2.0)
    assert sorted((t.row, t.col, t.tree_id) for t in tops.collect()) == [(5, 5, 0), (5, 17, 1)]
    for method in ("watershed", "grow"):
        whole = trees.crowns(canopy, tops, 1.0, method, tile=100.0, buffer=0.0).collect()
        tiled = trees.crowns(canopy, tops, 1.0, method, tile=12.0, buffer=12.0).collect()
        assert sorted(whole) == sorted(tiled) and {w.tree_id for w in whole} == {0, 1}
        assert all(w.tree_id == 0 for w in whole if w.col <= 5)


def test_registration_and_assignment(spark, cloud):
    df, _ = cloud
    m = points.translation(0.05, -0.03, 0.02) @ points.rotation_z(0.4)
    moved = points.transform(df, m)
    got, rmse, _ = fit.icp(df.filter("pid < 400"), moved, 1.0, rounds=15)
    assert np.abs(got - m).max() < 1e-3 and rmse < 1e-3
    r = np.random.default_rng(5)
    import itertools

    for n in (1, 3, 5):
        cost = r.random((n, n + 1))
        best = min(sum(cost[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n + 1), n))
        i, j = (v.ravel() for v in np.indices(cost.shape))
        got = fit.assign(i.tolist(), j.tolist(), cost.ravel().tolist())
        assert len(got) == n and cost.ravel()[got].sum() == pytest.approx(best)
    for _ in range(40):  # few candidates: most pairs first, then the least cost
        n, m = r.integers(1, 6, 2)
        held = [(i, j, float(r.random() ** 4 * 50)) for i in range(n) for j in range(m) if r.random() < 0.5]
        sets = [c for k in range(len(held) + 1) if k <= min(n, m) for c in itertools.combinations(range(len(held)), k)]
        fits = [c for c in sets if all(len({held[q][s] for q in c}) == len(c) for s in (0, 1))]
        size, best = min((-len(c), sum(held[q][2] for q in c)) for c in fits)
        got = fit.assign(*[list(v) for v in zip(*held, strict=True)]) if held else []
        assert len(got) == -size and sum(held[q][2] for q in got) == pytest.approx(best)
    assert fit.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-4)


def test_regression_against_numpy(spark):
    r = np.random.default_rng(6)
    x = r.uniform(1, 5, (40, 2))
    y = 2 + x @ [1.5, -0.7] + r.normal(0, 0.1, 40)
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(40), "a": x[:, 0], "b": x[:, 1], "y": y}))
    f = fit.Linear(df, "y", ["a", "b"])
    xx = np.column_stack([np.ones(40), x])
    beta, sse, *_ = np.linalg.lstsq(xx, y, rcond=None)
    assert f.beta == pytest.approx(beta) and f.sigma2 == pytest.approx(sse[0] / 37)
    loo = {k: v.loo for k, v in rows(f.leave_one_out(df), "id").items()}
    keep = np.arange(40) != 7
    b = np.linalg.lstsq(xx[keep], y[keep], rcond=None)[0]
    assert loo[7] == pytest.approx(y[7] - xx[7] @ b)
    p = f.predict(df.limit(1).withColumn("a", F.lit(9.0))).first()
    assert p.extrapolated and p.low < p.predicted < p.high


def test_waveforms(spark):
    x = np.arange(120)
    y = 5 + 40 * np.exp(-((x - 30.3) ** 2) / 8) + 15 * np.exp(-((x - 70.6) ** 2) / 18) + np.random.default_rng(7).normal(0, 0.3, 120)
    df = spark.createDataFrame([(1, y.tolist()), (2, []), (3, [1.0] * 50)], "wf_id long, samples array<double>")
    got = sorted((r.wf_id, r.echo, r.position, r.amplitude) for r in fit.decompose(df, threshold=6.0).collect())
    assert [g[:2] for g in got] == [(1, 0), (1, 1)] and [v for g in got for v in g[2:]] == pytest.approx([30.3, 40, 70.6, 15], abs=0.6)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["voxel_first", "grid_metrics", "opening", "knn", "interpolate_track", "gap_histogram", "occupancy_change", "trace_upright", "clusters", "stream_sessions"])
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    from pulsegrid.plans import catalog

    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = catalog.queries()[name](spark, DATA).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()[list(got.columns)]
    keys = sorted(got.columns)
    got, want = (f.sort_values(keys).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-6)


def test_utm_there_and_back(spark):
    from pulsegrid.functions import geo

    df = spark.createDataFrame([(147.0, -42.0), (148.9, -35.3), (146.2, -10.0)], "lon double, lat double")
    xy = geo.to_utm(df, 55, south=True)
    back = geo.from_utm(xy.withColumnsRenamed({"lon": "lon0", "lat": "lat0"}), 55, south=True).collect()
    assert all(abs(r.lon - r.lon0) < 1e-9 and abs(r.lat - r.lat0) < 1e-9 for r in back)
    first = xy.filter("lon = 147").first()
    assert first.x == pytest.approx(500000.0) and first.y == pytest.approx(10000000 - 0.9996 * 4651307.0, abs=500)


def test_leaf_projection(spark):
    from pulsegrid.functions import leaves

    assert leaves.projections("spherical") == pytest.approx(np.full(91, 0.5), abs=2e-3)
    assert leaves.projections("ellipsoidal", 1.0) == pytest.approx(np.full(91, 0.5), abs=2e-3)
    assert leaves.projections("planophile")[0] > 0.8 > leaves.projections("erectophile")[0]
    t = np.linspace(0, np.pi / 2, 20001)
    for f, a in (("uniform", ()), ("plagiophile", ()), ("extremophile", ()), ("beta", (2.5, 3.0)), ("ellipsoidal", (2.0,)), ("ellipsoidal", (0.5,))):
        assert np.trapezoid(leaves.density(f, t, *a), t) == pytest.approx(1, abs=2e-3)
    got = spark.createDataFrame([(0.0,), (45.5,), (90.0,)], "z double").select(leaves.projection("z", "planophile").alias("g")).collect()
    table = leaves.projections("planophile")
    assert [r.g for r in got] == pytest.approx([table[0], (table[45] + table[46]) / 2, table[90]])


def test_li_prune_and_contacts(spark):
    r = np.random.default_rng(8)
    p = np.concatenate([np.stack([cx + r.normal(0, 0.8, 200), np.full(200, 5.0) + r.normal(0, 0.8, 200), 10 - 2 * np.abs(r.normal(0, 1, 200))], 1) for cx in (5.0, 15.0)])
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(400), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "tree_id": np.arange(400) // 200}))
    got = trees.li_2012(df, tile=10.0, buffer=10.0).join(df, "pid").groupBy("tree").agg(F.countDistinct("tree_id").alias("n"), F.count("*").alias("c")).collect()
    assert all(g.n == 1 for g in got) and sum(g.c for g in got) >= 390
    t = spark.createDataFrame([(1, 0.0, 0.0, 5), (2, 0.5, 0.0, 9), (3, 1.0, 0.0, 7), (4, 1.45, 0.0, 1), (5, 9.0, 0.0, 1)], "tree_id long, x double, y double, n_points int")
    assert sorted(x.tree_id for x in trees.prune(t, 0.6).collect()) == [2, 4, 5]
    c = trees.contacts(df, 30.0).collect()
    assert len(c) == 1 and (c[0].a, c[0].b, c[0].n) == (0, 1, 40000)


def test_poses():
    from pulsegrid.operators import poses as s

    r = np.random.default_rng(9)
    for _ in range(20):
        x = r.normal(0, 1, 6)
        x[3:] *= min(1, 3 / np.linalg.norm(x[3:]))
        m = s.se3_exp(x)
        assert s.se3_log(m) == pytest.approx(x, abs=1e-9) and s.invert(m) @ m == pytest.approx(np.eye(4), abs=1e-12)
        y = r.normal(0, 1e-3, 6)
        assert m @ s.se3_exp(y) @ s.invert(m) == pytest.approx(s.se3_exp(s.adjoint(m) @ y), abs=1e-9)
    truth = [np.eye(4)] + [s.se3_exp(r.normal(0, 1, 6) * [5, 5, 1, 0.1, 0.1, 1]) for _ in range(4)]
    edges = [(i, j, s.invert(truth[i]) @ truth[j] @ s.se3_exp(r.normal(0, 1e-4, 6)), np.eye(6) * 1e4) for i in range(5) for j in range(i + 1, 5)]
    edges.append((0, 4, np.eye(4), np.eye(6)))  # a wrong one of little weight
    got = s.solve_pose_graph(5, edges)
    assert all(np.abs(a - b).max() < 5e-3 for a, b in zip(got, truth, strict=True))
    assert s.transform_difference(truth[1], truth[1] @ s.se3_exp(np.array([0.3, 0, 0.4, 0, 0, 0]))) == pytest.approx((0, 0.5), abs=1e-9)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_cover_every_point(spark):
    import inspect

    from pulsegrid.plans import catalog, views

    q = catalog.queries()
    p = views.points(spark, DATA).select("pid", "z", "classification").toPandas()
    for name in ("leaf_or_wood", "shortest_paths", "clusters_whole", "scan_ids_whole"):
        assert set(q[name](spark, DATA).toPandas()["pid"]) == set(p["pid"]), name  # two points share an id
    paths = q["shortest_paths"](spark, DATA).toPandas()
    assert set(paths.loc[paths["dist"] == 0, "pid"]) == set(p.loc[p["classification"] == 2, "pid"])
    assert "rounds" not in inspect.signature(graph.shortest_paths).parameters
    o = views.centres(spark, DATA).select("id", "x", "y").toPandas()
    assert set(q["scan_ids_whole"](spark, DATA).toPandas()["scan_id"]) <= set(o["id"]) and len(o) > 5
    low = p.loc[p["z"] < 24, "pid"]
    assert set(q["top_down_trees"](spark, DATA).toPandas()["pid"]) & set(low)
    assert q["icp_registration"](spark, DATA).first()["rounds"] < 30  # it stops where the residual stands still


def test_lonely_points_are_outliers(spark):
    rows = [(i, i * 0.1, 0.0, 0.0) for i in range(12)] + [(99, 500.0, 0.0, 0.0)]
    got = {r.pid: r for r in neighbours.statistical_outliers(spark.createDataFrame(rows, "pid long, x double, y double, z double"), 3, 3.0, limit=10.0).collect()}
    assert len(got) == 13 and got[99].keep is False and got[99].mean_distance is None and got[5].keep
