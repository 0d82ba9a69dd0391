"""Matching of targets (reflectors) of two scans without a first guess.

Each target makes triangles with pairs of its nearest ones, so triangles are as
many as targets.  A triangle is hashed by its three side lengths, which a rigid
move keeps; triangles of both scans that share a key and agree in their sides
propose a move each.  Moves are counted in coarse cells, the most wanted ones are
tried on all targets, and the one under which most targets meet is refined.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import cell
from ..plans.scratch import cut
from .fit import rigid
from .neighbours import knn, radius_join
from .points import transform

CORNERS = [f"{c}{k}" for k in (1, 2, 3) for c in "xyz"]
SIDES = ("s1", "s2", "s3")
MOVE = [f"m{i}{j}" for i in range(3) for j in range(4)]
#: Meetings of triangles at first, in all and for each target; more follow where these do not settle a move.
FIRST_MEETINGS, MEETINGS_EACH = 1_000_000, 50


def triangles(targets: DataFrame, neighbours: int, near: float, far: float) -> DataFrame:
    """Triangles of each target with two of its nearest, once each: sides by length, and the corner opposite to each.

    ``s1 <= s2 <= s3``; corner k is opposite to side k.  Flat triangles, whose
    corners are within a hundredth of a line, fix no move and are left out.
    """
    q = targets.select("id", "x", "y", "z")
    p = targets.select(F.col("id").alias("pid"), "x", "y", "z")
    close = knn(q, p, neighbours + 1, near, far, keep=("x", "y", "z")).filter("id != pid")
    a = close.select(F.col("id").alias("i"), F.col("pid").alias("j"), *[F.col(c).alias(f"{c}j") for c in "xyz"])
    b = close.select(F.col("id").alias("i"), F.col("pid").alias("k"), *[F.col(c).alias(f"{c}k") for c in "xyz"])
    own = targets.select(F.col("id").alias("i"), *[F.col(c).alias(f"{c}i") for c in "xyz"])
    # at most (neighbours choose 2) rows a target
    t = a.join(b, "i").filter("j < k").join(own, "i")
    # a triangle that several of its corners make stands once
    ids = F.array_sort(F.array("i", "j", "k"))
    t = t.withColumn("ids", ids).dropDuplicates(["ids"])

    def length(u: str, v: str):
        return F.sqrt(sum(((F.col(f"{c}{u}") - F.col(f"{c}{v}")) * (F.col(f"{c}{u}") - F.col(f"{c}{v}")) for c in "xyz"), F.lit(0.0)))

    corner = {v: F.struct(length(*o).alias("side"), *[F.col(f"{c}{v}").alias(c) for c in "xyz"]) for v, o in (("i", "jk"), ("j", "ik"), ("k", "ij"))}
    t = t.select("ids", F.array_sort(F.array(*corner.values())).alias("c"))
    flat = [F.col("c")[k]["side"].alias(s) for k, s in enumerate(SIDES)] + [F.col("c")[k][c].alias(f"{c}{k + 1}") for k in range(3) for c in "xyz"]
    return t.select("ids", *flat).filter("s1 + s2 - s3 > 0.01 * s3")


def moves(met: DataFrame) -> DataFrame:
    """The best rigid move of each pair of triangles (``x1..z3`` to ``u_x1..u_z3``), row by row in one array operation."""
    names = MOVE

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            c = {n: v.to_numpy(zero_copy_only=False) for n, v in zip(b.schema.names, b.columns, strict=True)}
            p, q = (np.stack([np.stack([c[f"{u}{a}{k}"] for a in "xyz"], 1) for k in (1, 2, 3)], 1) for u in ("", "u_"))
            pm, qm = p.mean(1), q.mean(1)
            u, _, vt = np.linalg.svd(np.einsum("nki,nkj->nij", p - pm[:, None], q - qm[:, None]))
            v = vt.transpose(0, 2, 1)
            v[:, :, 2] *= np.sign(np.linalg.det(v @ u.transpose(0, 2, 1)))[:, None]
            r = v @ u.transpose(0, 2, 1)
            t = qm - np.einsum("nij,nj->ni", r, pm)
            m = np.concatenate([r, t[:, :, None]], 2).reshape(len(p), 12)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(m[:, i])) for i in range(12)], names=names)

    return met.mapInArrow(run, ", ".join(f"{n} double" for n in names))


def links(a: DataFrame, b: DataFrame, m: np.ndarray, tolerance: float) -> DataFrame:
    """Targets that are each other's nearest within the tolerance after the move: ``id_a, id_b, d2`` and both places."""
    moved = transform(a.select("id", *[F.col(c).alias(f"a{c}") for c in "xyz"], "x", "y", "z"), m)
    p = b.select(F.col("id").alias("id_b"), "x", "y", "z")
    near = radius_join(moved, p, tolerance, 3, keep=("id", "ax", "ay", "az"))
    first = near.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("d2", "id_b"))).filter("r = 1")
    back = near.groupBy("id_b").agg(F.min_by("id", F.struct("d2", "id")).alias("id"))
    return first.join(back, ["id_b", "id"]).select(F.col("id").alias("id_a"), "id_b", "d2", "ax", "ay", "az", *[F.col(c).alias(f"b{c}") for c in "xyz"])


def proposed(met: DataFrame, a: DataFrame, b: DataFrame, tolerance: float, least: int, tries: int) -> tuple[np.ndarray | None, int]:
    """The move, of the ``tries`` that most triangles want, under which most targets meet, and their number; none below ``least``."""
    # where two sides are as good as equal, the corners may stand either way round; the trial decides
    found = moves(met.select(*CORNERS, *[f"u_{c}" for c in CORNERS]))
    turn, step = 0.05, 4 * tolerance
    grid = [F.floor(F.col(m) / (step if m.endswith("3") else turn) + 0.5).alias(f"g{m}") for m in MOVE]
    counted = found.groupBy(*grid).agg(F.count("*").alias("n"), *[F.avg(m).alias(m) for m in MOVE])
    top = counted.orderBy(F.desc("n"), *MOVE).limit(tries).collect()
    best, most = None, (least - 1, 0.0)
    for r in top:
        m = np.eye(4)
        m[:3] = np.array([r[x] for x in MOVE]).reshape(3, 4)
        u, _, vt = np.linalg.svd(m[:3, :3])  # a mean of turns is a little off a turn
        m[:3, :3] = u @ np.diag([1.0, 1.0, np.linalg.det(u @ vt)]) @ vt
        got = links(a, b, m, 2 * tolerance).agg(F.count("*").alias("n"), F.sum("d2").alias("d2")).first()
        if got["n"] > most[0] or got["n"] == most[0] and best is not None and got["d2"] < most[1]:
            best, most = m, (got["n"], got["d2"])
    return best, most[0]


def match_targets(a: DataFrame, b: DataFrame, tolerance: float = 0.05, side_tolerance: float = 0.03, least: int = 3, neighbours: int = 6, reach: float = 50.0, tries: int = 12) -> tuple[np.ndarray | None, DataFrame]:
    """The move that takes targets a onto b, and the matched ones ``id_a, id_b, distance``; none if fewer than ``least`` meet.

    Tables have ``id, x, y, z``; rows with a null take no part.  Of equally good
    moves the one with the smaller distances is taken.

    Among dense targets many triangles are alike, and their meetings grow faster than the
    targets.  So the rarest keys propose first, up to about as many meetings as targets; if under no
    move half of the smaller scan meets, sixteen times as many do, up to all.
    Targets of one place are one, the least id.
    """
    spark = a.sparkSession
    ok = " and ".join(f"{c} is not null" for c in ("id", "x", "y", "z"))
    a, b = (cut(t.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).filter(ok).groupBy("x", "y", "z").agg(F.min("id").alias("id")).select("id", "x", "y", "z")) for t in (a, b))
    none = spark.createDataFrame([], "id_a long, id_b long, distance double")
    mid = a.agg(*[F.avg(c).alias(c) for c in "xyz"]).first()
    if mid["x"] is None or b.isEmpty():
        return None, none
    centre = np.eye(4)
    centre[:3, 3] = [-mid[c] for c in "xyz"]
    a = transform(a, centre)
    width = 2 * side_tolerance
    start = min(5.0, reach)
    ta = triangles(a, neighbours, start, reach).withColumns({f"c{s}": cell(s, width) for s in SIDES})
    tb = triangles(b, neighbours, start, reach)
    tb = tb.select(*SIDES, *[F.col(c).alias(f"u_{c}") for c in CORNERS]).withColumnsRenamed({s: f"u_{s}" for s in SIDES})
    for s in SIDES:
        tb = tb.withColumn(f"c{s}", F.explode(F.sequence(F.floor((F.col(f"u_{s}") - side_tolerance) / width), F.floor((F.col(f"u_{s}") + side_tolerance) / width))))
    ta, tb = cut(ta), cut(tb)
    alike = F.lit(True)
    for s in SIDES:
        alike = alike & (F.abs(F.col(s) - F.col(f"u_{s}")) <= side_tolerance)
    keys = [f"c{s}" for s in SIDES]
    each = ta.groupBy(*keys).agg(F.count("*").cast("double").alias("na")).join(tb.groupBy(*keys).agg(F.count("*").alias("nb")), keys)
    each = cut(each.select(*keys, (F.col("na") * F.col("nb")).alias("n")).withColumn("size", F.floor(F.log2("n"))))
    sizes = each.groupBy("size").agg(F.sum("n").alias("n")).orderBy("size").collect()
    held = np.cumsum([r["n"] for r in sizes])
    na, nb = a.count(), b.count()
    meetings, best = max(float(FIRST_MEETINGS), float(MEETINGS_EACH) * max(na, nb)), None
    while len(sizes):
        whole = held[-1] <= meetings
        some = ta
        if not whole:
            most = sizes[max(int((held <= meetings).sum()) - 1, 0)]["size"]
            some = ta.join(each.filter(F.col("size") <= most).select(*keys), keys, "left_semi")
        best, met = proposed(some.join(tb, keys).filter(alike), a, b, tolerance, least, tries)
        if whole or best is not None and 2 * met >= min(na, nb):
            break
        meetings *= 16
    if best is None:
        return None, none
    for reach_now in (2 * tolerance, tolerance, tolerance):
        held = cut(links(a, b, best, reach_now))
        if held.count() < max(least, 3):
            return None, none
        best = rigid(held)
    held = cut(links(a, b, best, tolerance))
    if held.count() < least:
        return None, none
    return best @ centre, held.select("id_a", "id_b", F.sqrt("d2").alias("distance"))


def residual(found: DataFrame) -> float:
    """Root mean square distance of matched targets."""
    d = found.agg(F.avg(F.col("distance") * F.col("distance"))).first()[0]
    return math.sqrt(d) if d is not None else math.nan
