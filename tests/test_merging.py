from __future__ import annotations

import collections
import itertools
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pulsegrid.operators import merging


def brute(sizes, contacts, threshold, least_top):
    """All pairs looked at before every merge."""
    n = {t: v[0] for t, v in sizes.items()}
    top = {t: v[1] for t, v in sizes.items()}
    t = collections.defaultdict(float, contacts)
    into, live = {}, set(n)
    while True:
        found = []
        for a, b in itertools.permutations(live, 2):
            if (n[a], a) < (n[b], b) and min(top[a], top[b]) >= least_top and (t[a, b] or t[b, a]):
                share = t[a, b] / max(n[a], 1)
                if share >= threshold:
                    found.append((-share, a, b))
        if not found:
            break
        _, small, large = min(found)
        into[small] = large
        live.discard(small)
        for o in live - {large}:
            t[large, o] += t[small, o]
            t[o, large] = min(t[o, large] + t[o, small], n[o])
        n[large] += n[small]
        top[large] = max(top[large], top[small])
    out = {}
    for a in into:
        end = into[a]
        while end in into:
            end = into[end]
        out[a] = end
    return out


def made(r, trees, links):
    sizes = {i: (r.randint(1, 60), r.choice([1.0, 5.0, 9.0, 20.0])) for i in range(1, trees + 1)}
    contacts = {}
    for _ in range(links):
        a, b = r.sample(range(1, trees + 1), 2)
        contacts[a, b] = float(r.randint(1, max(1, sizes[a][0] // 3)))
        if r.random() < 0.8:
            contacts[b, a] = float(r.randint(1, max(1, sizes[b][0] // 3)))
    return sizes, contacts


def test_greedy_order_against_brute_force():
    for seed in range(150):
        r = random.Random(seed)
        sizes, contacts = made(r, r.randint(2, 14), r.randint(1, 40))
        for threshold in (0.05, 0.2, 0.5):
            assert merging.merged(sizes, contacts, threshold, 3.0) == brute(sizes, contacts, threshold, 3.0)


def test_groups_give_the_plan_of_the_whole(spark):
    for seed in range(3):
        sizes, contacts = made(random.Random(100 + seed), 120, 160)
        s = spark.createDataFrame([(t, n, top) for t, (n, top) in sizes.items()], "tree long, n long, top double")
        c = spark.createDataFrame([(a, b, int(n)) for (a, b), n in contacts.items()], "a long, b long, n long")
        got = {r.tree: r.into for r in merging.merge_plan(s, c, 0.3, 3.0).collect()}
        want = brute(sizes, contacts, 0.3, 3.0)
        assert got == want and 5 < len(want) < 110
    assert merging.merge_plan(s, c, 0.0).count() == 0 and merging.merge_plan(s.limit(0), c.limit(0)).count() == 0


def test_a_piece_joins_its_tree(spark):
    r = np.random.default_rng(5)

    def blob(x, n, low, high, side):
        return np.stack([r.uniform(x, x + side, n), r.uniform(0, side, n), r.uniform(low, high, n)], 1)

    parts = {1: blob(0, 4000, 0, 10, 2), 2: blob(2, 900, 3, 6, 1), 3: blob(6, 3000, 0, 10, 2), 4: blob(8, 50, 0, 1.5, 1)}
    rows = [(t, *map(float, p)) for t, ps in parts.items() for p in ps] + [(-1, 1.0, 1.0, 5.0)]
    df = pd.DataFrame(rows, columns=["tree_id", "x", "y", "z"])
    df.insert(0, "pid", range(len(df)))
    df["height"] = df.z
    points = spark.createDataFrame(df)
    got = merging.merge_touching(points, 0.1, 0.2, 0.4)
    assert got.columns == points.columns and got.count() == len(df)
    moved = {(a.tree_id, b.tree_id) for a, b in zip(points.orderBy("pid").collect(), got.orderBy("pid").collect(), strict=True)}
    assert moved == {(1, 1), (2, 1), (3, 3), (4, 4), (-1, -1)}  # 2 lies against 1; 4 is too low
    sizes, contacts = merging.touching(points, 0.2, 0.4)
    nodes = df[(df.tree_id > 0) & (df.height >= 0.5)].assign(k=lambda d: list(zip(*(np.floor(d[c] / 0.2).astype(int) for c in "xyz"), strict=True))).groupby("k").first()
    assert {r.tree: r.n for r in sizes.collect()} == nodes.groupby("tree_id").size().to_dict()
    xyz, lab = nodes[["x", "y", "z"]].to_numpy(), nodes.tree_id.to_numpy()
    want = collections.Counter()
    for i in range(len(xyz)):
        d = ((xyz - xyz[i]) ** 2).sum(1)
        near = [j for j in np.lexsort((nodes.pid.to_numpy(), d))[:9] if j != i and d[j] <= 0.16]
        want.update((lab[i], o) for o in {lab[j] for j in near} - {lab[i]})
    assert {(r.a, r.b): r.n for r in contacts.collect()} == dict(want)
    assert got.filter(F.col("tree_id") == 2).count() == 0
