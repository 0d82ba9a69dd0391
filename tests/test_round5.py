"""What the findings of the third round named: top-down trees, closest points, maps, targets, contacts and surveys at size."""

from __future__ import annotations

import time
import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import fit, points, scans, targets, trees
from pulsegrid.plans import more
from pulsegrid.plans.scratch import cut
from pulsegrid.sources import waveforms


def frame(spark, xyz, **more):
    return spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], **more}))


def one_by_one(xy, z, search=10.0, near=1.5, far=2.0, split=15.0):
    """Top-down trees by their definition: each point is held against all of both sides."""
    label, free = np.full(len(z), -1), np.arange(len(z))
    while len(free):
        mine, other = [free[0]], []
        close = free[np.hypot(*(xy[free] - xy[free[0]]).T) <= search]
        for i in close[1:]:
            a = np.hypot(*(xy[mine] - xy[i]).T).min()
            b = np.hypot(*(xy[other] - xy[i]).T).min() if other else np.inf
            limit = far if z[i] > split else near
            (other if a > limit and not other or a > b else mine).append(i)
        label[mine] = free[0]
        free = free[label[free] < 0]
    return label


@pytest.mark.parametrize(("n", "wide", "grain"), [(1, 5, 100), (60, 5, 1), (700, 20, 1), (700, 40, 10), (900, 25, 100)])
def test_top_down_trees_as_defined(spark, n, wide, grain):
    r = np.random.default_rng(n + grain)
    xyz = np.column_stack([np.floor(r.random((n, 2)) * wide * grain) / grain, np.round(2 + 28 * r.random(n), 1)])
    got = {p.pid: p.tree for p in trees.li_2012(frame(spark, xyz), tile=100.0, buffer=0.0).collect()}
    order = np.lexsort((np.arange(n), -xyz[:, 2]))
    want = one_by_one(xyz[order, :2], xyz[order, 2])
    assert got == {int(order[i]): int(order[t]) for i, t in enumerate(want)}


def test_top_down_trees_of_a_full_tile():
    r = np.random.default_rng(5)
    xy = r.random((150_000, 2)) * 45
    began = time.monotonic()
    top = trees.grown(xy, np.full(len(xy), 2.0), 10.0)
    assert time.monotonic() - began < 60 and (top <= np.arange(len(xy))).all() and top.min() == 0


def test_closest_in_a_task_against_all():
    r = np.random.default_rng(1)
    for k in range(12):
        p = np.unique(np.round(r.random((200, 3)) * (1, 5, 30)[k % 3], 1), axis=0)
        pid, q, reach = r.permutation(len(p)) + 5, np.round(r.random((150, 3)) * (40, 6)[k % 2] - (5, 0)[k % 2], 1), (0.3, 1.0, 4.0)[k // 4]
        which, d2 = fit.closest_in_task(p, pid, reach)(q)
        for i, at in enumerate(q):
            e = (p - at) ** 2
            e = e[:, 0] + e[:, 1] + e[:, 2]
            best = np.lexsort((pid, e))[0]
            assert (which[i], d2[i]) == (best, e[best]) if e[best] <= reach * reach else which[i] == -1


def test_closest_points_write_no_pairs_in_a_round(spark, monkeypatch):
    r = np.random.default_rng(2)
    xyz = r.random((800, 3)) * 12
    df = frame(spark, np.concatenate([xyz, xyz[:200]]))  # a fifth of the places stand twice
    m = points.translation(0.15, -0.1, 0.05) @ points.rotation_z(0.5)
    cuts = []
    monkeypatch.setattr(fit, "cut", lambda df: (cuts.append(1), cut(df))[1])
    got, rmse, rounds = fit.icp(df, points.transform(df, m), 1.0)
    assert rounds > 3 and len(cuts) == 3 and rmse < 1e-6 and np.abs(got - m).max() < 1e-6
    got, _, _ = fit.icp(df, points.transform(df, m), 1.0, trim=0.7)
    assert np.abs(got - m).max() < 1e-6
    # a start other than none
    far = points.translation(2.0, 0.0, 0.0)
    wide = frame(spark, np.column_stack([*(r.random((2, 300)) * 60), np.zeros(300)]))
    got, _, _ = fit.icp(wide, points.transform(wide, far), 1.0, start=points.translation(1.4, 0.1, 0.0))
    assert np.abs(got - far).max() < 1e-3


def test_packets_are_encoded_in_little_memory():
    r = np.random.default_rng(0)
    n = 40_000
    ends = np.r_[0, np.cumsum(r.integers(0, 12, n))].astype("i4")
    some = {c: np.zeros(n) for c in ("gps_time", *"xyz", "location_ps", "vx", "vy", "vz")}
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(r.integers(1, 51, ends[-1]).astype("f4")))
    rows = pa.table(some | {"returns": np.ones(n, "i4"), "interval_ps": np.full(n, 1000), "samples": lists})
    tracemalloc.start()
    got = waveforms.encode(rows, 0.001)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 6 * len(got)


@pytest.mark.parametrize("shared", [50, 22])
def test_stem_maps_meet_by_few_pairs_or_by_all(spark, monkeypatch, shared):
    tried, votes = [], scans.votes
    monkeypatch.setattr(scans, "FIRST_PAIRS", 1)
    monkeypatch.setattr(scans, "votes", lambda *args: (tried.append(args[5]), votes(*args))[1])
    r = np.random.default_rng(4)
    at, dbh = r.uniform(0, 60, (60, 2)), r.uniform(0.1, 0.9, 60)
    others = r.uniform(0, 60, (60 - shared, 2))
    ids = np.r_[np.arange(shared), 200 + np.arange(60 - shared)]
    a = spark.createDataFrame(pd.DataFrame({"id": np.r_[np.arange(60), 100 + np.arange(60)], "x": np.tile(at[:, 0], 2), "y": np.tile(at[:, 1], 2), "z": 0.0, "dbh": np.tile(dbh, 2)}))
    b = spark.createDataFrame(pd.DataFrame({"id": ids, "x": np.r_[at[:shared, 0], others[:, 0]], "y": np.r_[at[:shared, 1], others[:, 1]], "z": 0.0, "dbh": np.r_[dbh[:shared], r.uniform(1, 2, 60 - shared)]}))
    m = points.translation(7.0, -3.0, 0.0) @ points.rotation_z(40.0)
    _, pairs = scans.match_stem_maps(a, points.transform(b, m), 0.05, 0.01, 1.0, 25.0)
    assert {(p.id_a, p.id_b) for p in pairs.collect()} == {(i, i) for i in range(shared)}
    # few pairs do where over half of a map meets; else all are asked before an answer
    assert tried[0] < 25.0 and (tried[-1] == 25.0) == (shared < 30)


def test_targets_that_stand_several_times_meet_by_rare_triangles(spark, monkeypatch):
    monkeypatch.setattr(targets, "FIRST_MEETINGS", 1)
    monkeypatch.setattr(targets, "MEETINGS_EACH", 1)
    r = np.random.default_rng(7)
    at = np.tile(r.uniform([0, 0, 0], [40, 40, 4], (30, 3)), (8, 1))
    a = spark.createDataFrame(pd.DataFrame({"id": np.arange(240), "x": at[:, 0], "y": at[:, 1], "z": at[:, 2]}))
    m = points.translation(-4.0, 11.0, 0.5) @ points.rotation_z(-73.0)
    got, pairs = targets.match_targets(a, points.transform(a.filter("id % 30 < 24"), m), 0.02, 0.01)
    assert {(p.id_a, p.id_b) for p in pairs.collect()} == {(i, i) for i in range(24)} and np.abs(got - m).max() < 1e-6


def test_waveforms_are_sampled_in_arrays(spark):
    rows = spark.createDataFrame([(1, [3.0, 11.5]), (2, [0.25])], "wf_id long, heights array<double>")
    got = {p.wf_id: p.samples for p in more.sampled(rows).collect()}
    for k, at in ((1, [3.0, 11.5]), (2, [0.25])):
        assert got[k] == pytest.approx([sum(40 * np.exp(-((i - h * 2 - 8) ** 2) / 8) for h in at) for i in range(80)], abs=1e-12)
