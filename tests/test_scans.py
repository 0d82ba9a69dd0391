from __future__ import annotations

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import points, poses, scans

DATA = "/root/testdata/sf0.001"


def frame(spark, xyz, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **more}))


def test_stem_maps_meet_without_a_first_guess(spark):
    r = np.random.default_rng(9)
    stems = np.column_stack([r.uniform(0, 30, (25, 2)) + 500_000, np.zeros(25)])
    dbh = r.uniform(0.1, 0.5, 25)
    m = poses.se3_exp(np.array([3.0, -2, 0.5, 0, 0, 3.1]))
    b = stems[3:] @ m[:3, :3].T + m[:3, 3] + r.normal(0, 0.01, (22, 3))
    fa = frame(spark, stems, dbh=dbh).withColumnRenamed("pid", "id")
    fb = frame(spark, b, dbh=dbh[3:]).select((F.col("pid") + 3).alias("id"), "x", "y", "z", "dbh")
    found, pairs = scans.match_stem_maps(fa, fb)
    got = {(p.id_a, p.id_b) for p in pairs.collect()}
    assert got == {(i, i) for i in range(3, 25)}
    assert np.abs((stems @ found[:3, :3].T + found[:3, 3]) - (stems @ m[:3, :3].T + m[:3, 3])).max() < 0.05
    none, nobody = scans.match_stem_maps(fa.limit(2), fb.limit(1))
    assert none is None and nobody.count() == 0
    assert scans.match_stem_maps(fa.filter("id < 0"), fb)[0] is None
    assert scans.match_stem_maps(fa.withColumn("dbh", F.lit(None).cast("double")), fb)[0] is None


def wavy(n, seed):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 10, (2, n))
    xyz = np.column_stack([x, y, np.sin(x) + 0.5 * np.cos(1.3 * y)])
    normal = np.column_stack([-np.cos(x), 0.65 * np.sin(1.3 * y), np.ones(n)])
    return xyz, normal / np.linalg.norm(normal, axis=1)[:, None]


def test_planes_against_numpy(spark):
    xyz, nrm = wavy(1500, 3)
    target = frame(spark, xyz, nx=nrm[:, 0], ny=nrm[:, 1], nz=nrm[:, 2])
    move = points.translation(0.03, -0.02, 0.05) @ points.rotation_z(0.4, (5, 5, 0))
    back = poses.invert(move)
    src = xyz[::3] @ back[:3, :3].T + back[:3, 3]
    source = frame(spark, src)
    d2 = ((src[:, None] - xyz[None]) ** 2).sum(2)
    one, near = d2.argmin(1), np.sqrt(d2.min(1))
    ok = near <= 0.2
    got = scans.evaluate_registration(source, target, np.eye(4), 0.2).first()
    assert (got.n_inliers, got.fitness) == (ok.sum(), pytest.approx(ok.mean())) and got.inlier_rmse == pytest.approx(np.sqrt((near[ok] ** 2).mean()))
    p, q, n = src[ok], xyz[one[ok]], nrm[one[ok]]
    res = ((p - q) * n).sum(1)
    j = np.column_stack([n, np.cross(p, n)])
    w = np.where(np.abs(res) > 0.02, 0.02 / np.abs(res), 1.0)
    s = scans.plane_sums(source, target, np.eye(4), 0.2, 0.02).first()
    h, g = j.T @ (w[:, None] * j), j.T @ (w * res)
    assert [s[f"h{a}{b}"] for a in range(6) for b in range(a, 6)] == pytest.approx([h[a, b] for a in range(6) for b in range(a, 6)])
    assert [s[f"g{a}"] for a in range(6)] == pytest.approx(list(g)) and s["n"] == ok.sum()
    found, rmse, _ = scans.plane_icp(source, target, 0.5)
    assert np.abs(found - move).max() < 5e-3 and rmse < 5e-3
    empty = scans.evaluate_registration(source.filter("pid < 0"), target, np.eye(4), 0.2).first()
    assert (empty.fitness, empty.n_inliers, empty.inlier_rmse) == (0.0, 0, None)
    with pytest.raises(ValueError):
        scans.plane_icp(source, target.filter("pid < 3"), 0.2)


def test_reflectors(spark):
    r = np.random.default_rng(1)
    spot = np.array([5.0, 5, 1]) + r.uniform(-0.03, 0.03, (12, 3))
    sheet = np.column_stack([np.arange(30) * 0.1, np.zeros(30), np.zeros(30)])  # bright, but too wide
    v = r.uniform(5, 9, 12)
    df = frame(spark, np.concatenate([spot, sheet, [[20.0, 20, 0]]]), v=np.concatenate([v, np.full(31, 8.0)]))
    (got,) = scans.detect_reflectors(df, "v", 5.0).collect()
    w = v - v.min() + 1
    assert [got.x, got.y, got.z] == pytest.approx(list((spot * w[:, None]).sum(0) / w.sum())) and got.n == 12 and got.value == pytest.approx(np.median(v))


def test_flight_line_from_returns(spark):
    r = np.random.default_rng(2)
    t = np.sort(r.uniform(0, 2, 800))
    place = np.column_stack([100 + 60 * t, 20 - 5 * t, 900 + 2 * t])
    first = np.column_stack([100 + 60 * t + r.uniform(-200, 200, 800), 20 + r.uniform(-200, 200, 800), r.uniform(10, 30, 800)])
    way = first - place
    last = first + way / np.linalg.norm(way, axis=1)[:, None] * r.uniform(1, 12, (800, 1))
    last[::40] += r.uniform(2, 4, (20, 3))  # lines that miss the sensor
    rows = pd.DataFrame({"line": 1, "t": np.tile(t, 2), "rank": np.repeat([1, 2], 800), "x": np.r_[first[:, 0], last[:, 0]], "y": np.r_[first[:, 1], last[:, 1]], "z": np.r_[first[:, 2], last[:, 2]]})
    got = scans.estimate_trajectory(spark.createDataFrame(rows)).orderBy("t").toPandas()
    assert len(got) == 4 and got["n"].sum() <= 800
    want = np.column_stack([100 + 60 * got["t"], 20 - 5 * got["t"], 900 + 2 * got["t"]])
    assert np.abs(got[["x", "y", "z"]].to_numpy() - want).max() < 0.05 and got["vx"].to_numpy() == pytest.approx(np.full(4, 60), abs=0.5)
    assert scans.estimate_trajectory(spark.createDataFrame(rows), least=10_000).count() == 0


@pytest.mark.parametrize("start", [(4e5, 50.0, 100.0), (3e5, 2e5, 1e5)])
def test_trajectory_of_a_sensor_far_away(spark, start):
    r = np.random.default_rng(5)
    t = np.arange(800) / 400
    place = np.array(start) + np.outer(t, [10.0, 0.0, 0.0])
    first = r.uniform(0, [100, 100, 30], (800, 3))
    way = first - place
    second = first + 3 * way / np.linalg.norm(way, axis=1, keepdims=True)
    rows = [(0, float(a), k, *map(float, p)) for k, side in ((1, first), (2, second)) for a, p in zip(t, side, strict=True)]
    got = scans.estimate_trajectory(spark.createDataFrame(rows, "line long, t double, rank int, x double, y double, z double"), 2.0).first()
    assert np.abs(np.array([got.x, got.y, got.z]) - np.array(start) - [10 * got.t, 0, 0]).max() < 5e-4
    assert got.n == 800 and got.rms < 1e-6 and abs(got.vx - 10) < 5e-4


def test_leaf_area_of_a_sheet(spark):
    r = np.random.default_rng(4)
    xyz = np.column_stack([r.uniform(0, 2, (20_000, 2)), np.zeros(20_000) + 0.51])
    got = scans.leaf_area_density(frame(spark, xyz), 1.0, 0.1).toPandas()
    assert got["area"].sum() == pytest.approx(4.0, rel=0.03) and (got["density"] == got["area"]).all() and len(got) == 4


def test_views_of_nothing(spark):
    none = frame(spark, np.zeros((1, 3))).filter("pid < 0")
    assert scans.hemisphere_from_points(none).count() == 0
    assert scans.detect_reflectors(none.withColumn("v", F.lit(1.0)), "v", 0.5).count() == 0
    assert scans.tiles_from_scans([none, none], 10.0, 0.5).count() == 0


QUERIES = ["evaluate_registration", "plane_registration", "match_stem_maps", "detect_reflectors", "stem_noise", "hemisphere_from_points", "fired_from_returns", "tiles_from_scans", "estimate_trajectory", "grid_aggregates", "transform_vectors"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", QUERIES)
def test_queries_agree_with_their_sql(spark, name):
    import duckdb

    from pulsegrid.plans import catalog

    data = DATA if name not in ("detect_reflectors", "stem_noise") else DATA.replace("0.001", "0.01")  # few points make no clusters
    con = duckdb.connect()
    for t in ("lineitem", "orders", "supplier", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    got = catalog.queries()[name](spark, data).toPandas()
    want = con.execute(catalog.oracle_sql()[name]).df()[list(got.columns)]
    assert len(got)
    keys = sorted(got.columns)
    got, want = (f.sort_values(keys).reset_index(drop=True) for f in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-6, atol=2e-6)
