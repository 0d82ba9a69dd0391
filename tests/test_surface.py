from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from pulsegrid.operators import surface

P = "x double, y double, z double, pulse long"


def exact(a, b):
    """The share of all splits of the pooled pulses with at least the difference seen."""
    pool, d = [*a, *b], abs(max(b) - max(a))
    splits = list(itertools.combinations(range(len(pool)), len(a)))
    hit = 0
    for s in splits:
        one = max(pool[i] for i in s)
        two = max(pool[i] for i in range(len(pool)) if i not in s)
        hit += abs(one - two) >= d - 1e-12
    return hit / len(splits)


def test_chance_against_every_split(spark):
    r = np.random.default_rng(1)
    one, two, cells = [], [], {}
    for k in range(40):
        a = np.round(r.uniform(0, 5, int(r.integers(1, 6))), 1).tolist()
        b = np.round(r.uniform(0, 5, int(r.integers(1, 6))) + (2 if k % 3 == 0 else 0), 1).tolist()
        cells[k] = a, b
        one += [(k + 0.5, 0.5, z, 10 * k + i) for i, z in enumerate(a)] + [(k + 0.5, 0.5, min(a) - 1, 10 * k)]
        two += [(k + 0.5, 0.5, z, 10 * k + i) for i, z in enumerate(b)]
    one += [(90.5, 0.5, 1.0, 1), (91.5, 0.5, float("nan"), 2)]  # no second survey there
    got = {x.col: x for x in surface.surface_change(spark.createDataFrame(one, P), spark.createDataFrame(two, P), 1.0, alpha=0.3).collect()}
    assert set(got) == set(cells)
    for k, (a, b) in cells.items():
        x = got[k]
        assert (x.n_a, x.n_b, x.value_a, x.value_b) == (len(a), len(b), max(a), max(b))
        # equal values: the form counts those above the lower maximum, and so never says less than the splits do
        assert x.p >= exact(a, b) - 1e-12
        if len({*a, *b}) == len(a) + len(b):
            assert x.p == pytest.approx(exact(a, b))
            if x.lod is not None:
                assert x.significant == (exact(a, b) <= 0.3) == (abs(max(b) - max(a)) >= x.lod - 1e-12)
            else:
                assert not x.significant


def test_null_keeps_its_level_and_noise_widens(spark):
    r = np.random.default_rng(2)
    make = lambda lift: spark.createDataFrame([(float(c) + 0.5, float(w) + 0.5, float(r.normal(10, 2)) + lift, 1000 * c + 50 * w + i) for c in range(30) for w in range(20) for i in range(12)], P)
    a, same, grown = make(0.0), make(0.0), make(6.0)
    still = surface.surface_change(a, same, 1.0)
    assert still.filter("significant").count() <= 0.05 * 600 + 3 * math.sqrt(0.05 * 0.95 * 600)
    raised = surface.surface_change(a, grown, 1.0)
    assert raised.filter("significant and diff > 0").count() >= 0.8 * 600
    wide = surface.surface_change(a, grown, 1.0, noise=3.0)
    assert wide.filter("significant").count() < raised.filter("significant").count()
    assert {x.sign: x.cells for x in surface.change_summary(raised).collect()}["gain"] == raised.filter("significant and diff > 0").count()
    assert surface.surface_change(a.limit(0), grown, 1.0).count() == 0
