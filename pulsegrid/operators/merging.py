"""Merging of trees that lie against a larger neighbour.

Contacts are counted by joins.  The greedy order of merges (the largest share of a
smaller tree's nodes first, contacts counted anew after each merge) binds only
trees that merges can bring together: a tree whose contacts with all others
together stay below the threshold is never merged into one of them, nor can a
group of such trees.  So trees are linked where one of two that touch could be
merged at all, and each linked group is merged by itself, in order.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import cut
from .graph import components
from .neighbours import knn
from .points import voxel_first


def touching(points: DataFrame, voxel: float = 0.05, reach: float = 0.1, low: float = 0.5, k: int = 8) -> tuple[DataFrame, DataFrame]:
    """Sizes ``tree, n, top`` and contacts ``a, b, n`` of labelled trees.

    ``points(pid, x, y, z, height, tree_id)`` of at least ``low`` with an id above 0
    are thinned to the first of each voxel.  A node of tree a touches tree b if one
    of its ``k`` nearest nodes within ``reach`` is of b.
    """
    own = points.filter((F.col("tree_id") > 0) & (F.col("height") >= low)).select("pid", "x", "y", "z", "height", "tree_id")
    nodes = cut(voxel_first(own, voxel))
    sizes = nodes.groupBy(F.col("tree_id").alias("tree")).agg(F.count("*").alias("n"), F.max("height").alias("top"))
    near = knn(nodes.select(F.col("pid").alias("id"), "x", "y", "z"), nodes, k + 1, reach, reach, keep=("tree_id",))
    # a node is its own nearest, unless k others share its place
    near = near.filter("id != pid and rank <= {}".format(k + 1))
    pairs = near.join(nodes.select(F.col("pid").alias("id"), F.col("tree_id").alias("a")), "id").filter("a != tree_id")
    counts = pairs.select("id", "a", F.col("tree_id").alias("b")).distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    return cut(sizes), cut(counts)


def merged(sizes: dict[int, tuple[float, float]], contacts: dict[tuple[int, int], float], threshold: float, least_top: float) -> dict[int, int]:
    """``tree: the one it ends in`` for the trees of one group that are merged."""
    n = {t: v[0] for t, v in sizes.items()}
    top = {t: v[1] for t, v in sizes.items()}
    touch: dict[int, dict[int, float]] = {t: {} for t in n}
    for (a, b), v in contacts.items():
        touch[a][b] = v
        touch[b].setdefault(a, 0.0)
    into: dict[int, int] = {}

    def pair(a: int, b: int) -> tuple | None:
        """The pair as it stands, ready for the queue; none if it cannot be merged."""
        small, large = (a, b) if (n[a], a) < (n[b], b) else (b, a)
        share = touch[small].get(large, 0.0) / max(n[small], 1.0)
        return (-share, small, large) if share >= threshold and min(top[a], top[b]) >= least_top else None

    queue = [p for a in touch for b in touch[a] if a < b and (p := pair(a, b))]
    heapq.heapify(queue)
    while queue:
        best = heapq.heappop(queue)
        _, small, large = best
        if small in into or large in into or large not in touch[small] or pair(small, large) != best:
            continue  # an earlier merge has changed it; the pair as it stands is queued by itself
        into[small] = large
        n[large] += n[small]
        top[large] = max(top[large], top[small])
        for other, t in touch.pop(small).items():
            back = touch[other].pop(small, 0.0)
            if other != large:
                touch[large][other] = touch[large].get(other, 0.0) + t
                touch[other][large] = min(touch[other].get(large, 0.0) + back, n[other])
        queue += [p for other in touch[large] if (p := pair(large, other))]
        heapq.heapify(queue)
    out = {}
    for t in into:
        end = into[t]
        while end in into:
            end = into[end]
        out[t] = end
    return out


def merge_plan(sizes: DataFrame, contacts: DataFrame, threshold: float = 0.1, least_top: float = 3.0) -> DataFrame:
    """``tree, into`` of the trees that are merged."""
    if threshold <= 0:
        return sizes.select("tree", F.col("tree").alias("into")).limit(0)
    outward = contacts.groupBy("a").agg(F.sum("n").alias("out"))
    open_trees = cut(sizes.join(outward, sizes["tree"] == outward["a"]).filter(F.col("out") >= threshold * F.col("n")).select("tree"))
    one = contacts.join(open_trees.withColumnRenamed("tree", "a"), "a", "left_semi").select("a", "b")
    # contacts count from either side: the larger one's nodes may touch where the smaller one's do not
    two = contacts.join(open_trees.withColumnRenamed("tree", "b"), "b", "left_semi").select("a", "b")
    links = cut(one.union(two).distinct())
    nodes = links.select(F.col("a").alias("pid")).union(links.select("b")).distinct()
    groups = cut(components(nodes, links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).select(F.col("pid").alias("tree"), F.col("component").alias("group")))
    rows = groups.join(sizes, "tree").select("group", F.col("tree").alias("a"), F.lit(None).cast("long").alias("b"), F.col("n").cast("double").alias("n"), F.col("top").cast("double").alias("top"))
    other = groups.select(F.col("tree").alias("b"), F.col("group").alias("group_b"))
    pairs = contacts.join(groups.withColumnRenamed("tree", "a"), "a").join(other, "b").filter("group = group_b")
    rows = rows.union(pairs.select("group", "a", "b", F.col("n").cast("double"), F.lit(None).cast("double")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        alone = pdf["b"].isna()
        of = {int(r.a): (r.n, r.top) for r in pdf[alone].itertuples()}
        touch = {(int(r.a), int(r.b)): r.n for r in pdf[~alone].itertuples()}
        found = merged(of, touch, threshold, least_top)
        return pd.DataFrame({"tree": list(found), "into": list(found.values())}, dtype="int64")

    return rows.groupBy("group").applyInPandas(solve, "tree long, into long")


def merge_touching(points: DataFrame, threshold: float = 0.1, voxel: float = 0.05, reach: float = 0.1, low: float = 0.5, least_top: float = 3.0, k: int = 8) -> DataFrame:
    """``points`` with the ``tree_id`` of the tree that each one's tree ends in.

    Of all pairs of trees, that in which the largest share of the smaller tree's
    nodes touch the larger is merged first, if it is at least ``threshold`` and both
    rise to ``least_top``; the merged tree keeps the larger one's id, its nodes and
    contacts are those of both, and so on until no pair is left.  Ties go to the
    smaller ids.
    """
    plan = cut(merge_plan(*touching(points, voxel, reach, low, k), threshold, least_top))
    out = points.join(plan.withColumnRenamed("tree", "tree_id"), "tree_id", "left")
    return out.withColumn("tree_id", F.coalesce("into", "tree_id")).select(*points.columns)
