from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import survey, trees


def returns(spark, n, seed, lift=0.0, cells=2):
    r = np.random.default_rng(seed)
    x, y = r.uniform(0, 20 * cells, n), r.uniform(0, 20, n)
    z = r.gamma(3, 4, n) + np.where(x < 20, lift, 0.0)
    k = np.arange(n)
    return spark.createDataFrame(pd.DataFrame({"pid": k, "pulse": k // 2, "x": x, "y": y, "z": z, "return_number": 1 + k % 2, "classification": 1}))


def test_permutation_test_finds_growth_alone(spark):
    a, b = returns(spark, 3000, 11), returns(spark, 2500, 12, lift=3.0)
    got = {(r.col, r.metric): r for r in survey.metric_change(a, b, 20.0, stratum=5.0, permutations=60).collect()}
    assert len(got) == 2 * len(survey.TESTED)
    assert got[0, "zmean"].significant and got[0, "zmean"].diff == pytest.approx(3.0, abs=0.8) and got[0, "zq95"].significant
    assert not got[1, "zmean"].significant and abs(got[1, "zmean"].bias) < 0.2
    again = {(r.col, r.metric): r for r in survey.metric_change(a.repartition(3), b.repartition(2), 20.0, stratum=5.0, permutations=60).collect()}
    assert {k: v.lower for k, v in got.items()} == {k: v.lower for k, v in again.items()}
    plain = {(r.col, r.metric): r.diff for r in survey.metric_difference(a, b, 20.0).collect()}
    assert plain == pytest.approx({k: v.diff for k, v in got.items()})


def test_permutations_keep_the_numbers_of_each_stratum():
    r = np.random.default_rng(3)
    n = 400
    pulse, later = np.arange(n) // 2, (np.arange(n) // 2) % 3 == 0
    stratum = pulse // 20
    z = r.random(n)
    seen = []
    old = survey.summary
    try:
        survey.summary = lambda z, f, c: (seen.append(len(z)), np.zeros(5))[1]
        survey.permuted(z, np.ones(n, bool), pulse, stratum, later.astype(int), 5, [1], 2.0)
    finally:
        survey.summary = old
    assert seen[0::2] == [later.sum()] * 5 and seen[1::2] == [(~later).sum()] * 5


def test_harmonised_surveys_have_like_densities(spark):
    a, b = returns(spark, 8000, 4), returns(spark, 2000, 5)
    got = survey.harmonise(a, b, 10.0)
    n = got.count()
    assert n == pytest.approx(2000, rel=0.15) and got.columns == a.columns
    assert got.groupBy("pulse").count().filter("count <> 2").isEmpty()
    assert survey.harmonise(b, a, 10.0).count() == pytest.approx(2000, rel=0.12)
    assert survey.harmonise(b, a.filter("x < 0"), 10.0).count() == 2000  # nothing to compare with


def test_minimum_distance_against_brute_force(spark):
    r = np.random.default_rng(6)
    p = r.uniform(0, 4, (500, 3))
    kept = []
    for i in range(500):
        if all(((p[i] - p[j]) ** 2).sum() >= 0.36 for j in kept):
            kept.append(i)
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(500), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "q": 1})).repartition(3)
    got = trees.min_distance_subsample(df, 0.6)
    assert sorted(x.pid for x in got.collect()) == kept and got.columns == df.columns
    line = spark.createDataFrame([(i, 0.5 * i, 0.0, 0.0) for i in range(6)], "pid long, x double, y double, z double")
    assert trees.min_distance_subsample(line, 0.5).count() == 6
    assert sorted(x.pid for x in trees.min_distance_subsample(line, 0.6).collect()) == [0, 2, 4]


def test_crown_area_is_that_of_the_whole_hull(spark):
    r = np.random.default_rng(7)
    p = r.normal(0, 6, (3000, 2))
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(3000), "x": p[:, 0], "y": p[:, 1], "z": 10.0 + r.random(3000), "tree_id": np.arange(3000) % 2}))
    got = {x.tree_id: x.area for x in trees.crown_metrics(df).collect()}
    for k in (0, 1):
        own = p[np.arange(3000) % 2 == k]
        # each edge of the hull has all points on one side: check by support in many directions
        c = trees.hull(own[:, 0], own[:, 1])
        d = np.stack([np.cos(np.linspace(0, 2 * np.pi, 720)), np.sin(np.linspace(0, 2 * np.pi, 720))])
        assert (c @ d).max(axis=0) == pytest.approx((own @ d).max(axis=0))
    base = {x.tree_id: x.base for x in trees.crown_metrics(df).collect()}
    high = df.toPandas()
    for k in (0, 1):
        own = high[(high["tree_id"] == k) & (high["z"] >= base[k])]
        assert got[k] == pytest.approx(trees.hull_area(own["x"].to_numpy(), own["y"].to_numpy()))


def test_taper_and_segmentation(spark):
    r = np.random.default_rng(8)
    parts = []
    for k, cx in enumerate((2.0, 6.0)):
        a, h = r.uniform(0, 2 * np.pi, 6000), r.uniform(0, 6, 6000)
        rad = 0.3 - 0.03 * h
        parts.append(np.column_stack([cx + rad * np.cos(a), rad * np.sin(a), h, np.full(6000, k)]))
    p = np.concatenate(parts)
    df = spark.createDataFrame(pd.DataFrame({"pid": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "truth": p[:, 3].astype(int)}))
    stems = spark.createDataFrame([(0, 2.0, 0.0), (1, 6.0, 0.0)], "stem long, x double, y double")
    taper = trees.dbh_profile(df, stems, 1.0, 0.2).collect()
    assert len(taper) == 2 * 7 and all(t.diameter == pytest.approx(2 * (0.3 - 0.03 * t.height), abs=0.02) for t in taper)
    thin = trees.min_distance_subsample(df, 0.12)
    got = trees.segment_trees(thin, stems, 0.4, 2.0, seed_radius=0.5).join(df.select("pid", "truth"), "pid")
    assert got.filter("tree_id = truth").count() == thin.count()


def test_variable_windows(spark):
    rows = [(0, 0, 20.0), (0, 2, 19.0), (0, 10, 6.0), (0, 12, 5.0)]
    canopy = spark.createDataFrame(rows, "row long, col long, value double")
    assert sorted(x.col for x in trees.variable_tops(canopy, 1.0, 1.0, 0.3, 10.0).collect()) == [0, 10, 12]
    assert sorted(x.col for x in trees.variable_tops(canopy, 1.0, 5.0, 0.0, 10.0).collect()) == [0, 10]
