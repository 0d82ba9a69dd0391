"""Queries of registrations, stem maps, targets, views from a point, and the flight line."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import metrics, neighbours, pulses, scans, targets
from ..operators import points as ops
from .catalog import query
from .scratch import cut
from .views import centres, later_points, shots
from .views import points as point_view

AROUND = "(SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)"


@query(
    f"""WITH b AS (SELECT *, floor(x) + i AS cx, floor(y) + j AS cy, floor(z) + k AS cz FROM later, {AROUND}), a AS (SELECT pid, x + 0.1 AS x, y - 0.05 AS y, z FROM p),
    n AS (SELECT a.pid, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d2 FROM a JOIN b ON floor(a.x) = b.cx AND floor(a.y) = b.cy AND floor(a.z) = b.cz GROUP BY 1)
    SELECT count(*) / (SELECT count(*) FROM p) AS fitness, sqrt(avg(d2)) AS inlier_rmse, count(*) AS n_inliers FROM n WHERE d2 <= 0.45::DOUBLE * 0.45::DOUBLE""",
    "fitness inlier_rmse",
)
def evaluate_registration(spark, d):
    return scans.evaluate_registration(point_view(spark, d), later_points(spark, d), ops.translation(0.1, -0.05, 0.0), 0.45)


@query(
    """SELECT i AS row, j AS col, CASE WHEN i = j THEN 1.0 WHEN j = 3 THEN [0.004, -0.003, 0.002, 0.0][i + 1] ELSE 0 END::DOUBLE AS value
    FROM (SELECT unnest(generate_series(0, 3))::INT AS i), (SELECT unnest(generate_series(0, 3))::INT AS j)""",
    "value",
)
def plane_registration(spark, d):
    """Point-to-plane steps give back the move between two copies of the cloud."""
    p = cut(point_view(spark, d).select("pid", "x", "y", "z").dropDuplicates(["pid"]))
    moved = ops.transform(p, ops.translation(0.004, -0.003, 0.002))
    target = neighbours.shape(moved, 12, 2.0, 50.0, place=True)
    found, _, _ = scans.plane_icp(p, target, 0.3)
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(found)], "row int, col int, value double")


@query("SELECT id AS id_a, id AS id_b FROM centres WHERE id % 7 <> 0")
def match_stem_maps(spark, d):
    """The stems of two maps, one turned, moved and thinned, without a first guess."""
    a = centres(spark, d).select("id", "x", "y", F.lit(0.0).alias("z"), ((F.col("value") + 2000) / 20000).alias("dbh"))
    b = ops.transform(a.filter("id % 7 <> 0"), ops.translation(7.0, -3.0, 1.0) @ ops.rotation_z(40.0))
    return scans.match_stem_maps(a, b, 0.05, 0.01, 1.0, 25.0)[1].select("id_a", "id_b")


@query(
    f"""WITH RECURSIVE v AS (SELECT pid, x, y, z, intensity::DOUBLE AS v FROM p WHERE intensity >= 5000),
    e AS (SELECT a.pid AS s, b.pid AS d FROM (SELECT *, floor(x / 2) AS cx, floor(y / 2) AS cy, floor(z / 2) AS cz FROM v) a, (SELECT *, floor(x / 2) + i AS cx, floor(y / 2) + j AS cy, floor(z / 2) + k AS cz FROM v, {AROUND}) b
      WHERE a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 4.0),
    r(pid, c) USING KEY (pid) AS (SELECT pid, pid FROM v UNION SELECT e.d, min(r.c) FROM r JOIN e ON e.s = r.pid JOIN recurring.r k ON k.pid = e.d WHERE r.c < k.c GROUP BY e.d),
    h AS (SELECT c, x, y, z, v, v - min(v) OVER (PARTITION BY c) + 1 AS w FROM r JOIN v USING (pid))
    SELECT c AS target, sum(x * w) / sum(w) AS x, sum(y * w) / sum(w) AS y, sum(z * w) / sum(w) AS z, median(v) AS value, sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))) AS diameter, count(*) AS n
    FROM h GROUP BY 1 HAVING count(*) >= 2 AND greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) <= 8.0""",
    "x y z value diameter",
)
def detect_reflectors(spark, d):
    return scans.detect_reflectors(point_view(spark, d), "intensity", 5000, 2.0, 2, 8.0)


@query(
    """WITH t AS (SELECT *, CAST(floor(z / 0.25 + 0.5) AS BIGINT) AS slice FROM p), n AS (SELECT c.id AS stem, t.slice, t.x, t.y FROM t JOIN centres c ON (t.x - c.x) * (t.x - c.x) + (t.y - c.y) * (t.y - c.y) <= 225.0 WHERE abs(t.z - t.slice * 0.25::DOUBLE) <= 0.05 AND z BETWEEN 1 AND 3),
    m AS (SELECT stem, slice, avg(x) AS mx, avg(y) AS my FROM n GROUP BY 1, 2), q AS (SELECT stem, slice, mx, my, x - mx AS u, y - my AS v FROM n JOIN m USING (stem, slice)),
    s AS (SELECT stem, slice, mx, my, count(*) AS n, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu FROM q GROUP BY 1, 2, 3, 4),
    c AS (SELECT *, ((uuu + uvv) / 2 * vv - (vvv + vuu) / 2 * uv) / (uu * vv - uv * uv) AS cu, ((vvv + vuu) / 2 * uu - (uuu + uvv) / 2 * uv) / (uu * vv - uv * uv) AS cv FROM s WHERE n >= 3 AND abs(uu * vv - uv * uv) > 1e-12),
    f AS (SELECT stem, slice, n AS had, mx + cu AS cx, my + cv AS cy, sqrt(cu * cu + cv * cv + (uu + vv) / n) AS radius FROM c),
    r AS (SELECT *, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) - radius AS r FROM n JOIN f USING (stem, slice))
    SELECT stem, slice, count(*) AS n, radius, sqrt(avg(r * r)) AS rms, median(abs(r)) AS mad, count(DISTINCT floor(degrees(atan2(y - cy, x - cx)) / 10)) * 10 AS arc FROM r WHERE abs(r) <= greatest(0.05::DOUBLE, 0.3 * radius) GROUP BY stem, slice, radius HAVING count(*) >= 4""",
    "radius rms mad",
)
def stem_noise(spark, d):
    stems = centres(spark, d).select(F.col("id").alias("stem"), "x", "y")
    return scans.stem_noise(point_view(spark, d), stems, search=15.0).filter("n >= 4")


@query(
    """WITH s AS (SELECT x - 50.005::DOUBLE AS dx, y - 50.005::DOUBLE AS dy, z - 1.505::DOUBLE AS dz FROM p), q AS (SELECT *, sqrt(dx * dx + dy * dy) AS flat, sqrt(dx * dx + dy * dy + dz * dz) AS near FROM s),
    a AS (SELECT *, 32 * degrees(atan2(flat, dz)) / 90.0::DOUBLE AS r FROM q WHERE degrees(atan2(flat, dz)) <= 90 AND near > 0)
    SELECT CAST(least(floor(32 - r * (dy / flat)), 63) AS BIGINT) AS row, CAST(least(floor(32 + r * (dx / flat)), 63) AS BIGINT) AS col, count(*) AS points, min(near) AS near FROM a GROUP BY 1, 2""",
    "near",
)
def hemisphere_from_points(spark, d):
    return scans.hemisphere_from_points(point_view(spark, d), (50.005, 50.005, 1.505), 64)


@query(
    """WITH s AS (SELECT quantile_cont(zenith, 0.999) AS hi, count(*) FILTER (zenith BETWEEN 60 AND 80) / 20.0::DOUBLE AS rate FROM shots WHERE len(echoes) > 0)
    SELECT ring, rate * greatest(least((ring + 1) * 5.0::DOUBLE, hi) - greatest(ring * 5.0::DOUBLE, greatest(hi - 70.0::DOUBLE, 0.0)), 0) AS fired FROM s, (SELECT unnest(generate_series(0, 35)) AS ring)""",
    "fired",
)
def fired_from_returns(spark, d):
    return scans.fired_from_returns(shots(spark, d).filter(F.size("echoes") > 0), 5.0, (60.0, 80.0), 0.001, 70.0)


@query(
    """WITH c AS (SELECT pid, x, y, z, 0 AS scan_id FROM p UNION ALL SELECT pid, x + 0.25, y, z, 1 FROM later), k AS (SELECT * FROM c WHERE x BETWEEN 10 AND 90 AND y BETWEEN 10 AND 90),
    f AS (SELECT arg_min({'pid': pid, 'x': x, 'y': y, 'z': z, 'scan_id': scan_id}, (scan_id, pid)) AS s FROM k GROUP BY floor(x / 0.5), floor(y / 0.5), floor(z / 0.5))
    SELECT s.pid AS pid, s.x AS x, s.y AS y, s.z AS z, s.scan_id AS scan_id, CAST(floor(s.x / 10) AS BIGINT) AS tx, CAST(floor(s.y / 10) AS BIGINT) AS ty FROM f""",
    "x y z",
)
def tiles_from_scans(spark, d):
    both = [point_view(spark, d), later_points(spark, d)]
    out = scans.tiles_from_scans(both, 10.0, 0.5, [None, ops.translation(0.25, 0.0, 0.0)], (10.0, 10.0, 90.0, 90.0))
    return out.select("pid", "x", "y", "z", "scan_id", "tx", "ty")


@query(
    """WITH u AS (SELECT (pid // 1073741824) / 1024.0::DOUBLE AS t, (pid // 1073741824) % 2 AS line FROM p GROUP BY ALL)
    SELECT line, CAST(floor(t / 2.0) AS BIGINT) AS bin, avg(t) AS t, round(10 * avg(t), 3) AS x, 50.0::DOUBLE AS y, 100.0::DOUBLE AS z, 10.0::DOUBLE AS vx, 0.0::DOUBLE AS vy, 0.0::DOUBLE AS vz, 0.0::DOUBLE AS rms, count(*) AS n FROM u GROUP BY 1, 2 HAVING count(*) >= 30""",
    "t x y z vx vy vz rms",
)
def estimate_trajectory(spark, d):
    """The way of a sensor that sees each point and, three metres behind it, another."""
    key = F.floor(F.col("pid") / 1073741824)
    one = point_view(spark, d).groupBy(key.alias("k")).agg(F.min_by(F.struct("x", "y", "z"), "pid").alias("p"))
    first = one.select((F.col("k") % 2).alias("line"), (F.col("k") / 1024.0).alias("t"), F.lit(1).alias("rank"), "p.*")
    dx, dy, dz = F.col("x") - 10 * F.col("t"), F.col("y") - 50.0, F.col("z") - 100.0
    far = 3.0 / F.sqrt(dx * dx + dy * dy + dz * dz)
    second = first.select("line", "t", F.lit(2).alias("rank"), (F.col("x") + dx * far).alias("x"), (F.col("y") + dy * far).alias("y"), (F.col("z") + dz * far).alias("z"))
    out = scans.estimate_trajectory(first.union(second), 2.0, 30, 2.0)
    return out.withColumns({c: F.round(c, 3) for c in ("x", "y", "z", "vx", "vy", "vz", "rms")})


@query()
def leaf_area_density(spark, d):
    return scans.leaf_area_density(point_view(spark, d), 10.0, 1.0, 12, 50.0)


@query(
    """SELECT CAST(floor(y / 20.0) AS BIGINT) AS row, CAST(floor(x / 20.0) AS BIGINT) AS col, quantile_cont(z, 0.75) - quantile_cont(z, 0.25) AS spread, avg(CASE WHEN return_number = 1 AND z > 10 THEN 1.0 ELSE 0.0 END)::DOUBLE AS high_first, count(DISTINCT tree_id) AS trees
    FROM p GROUP BY 1, 2""",
    "spread high_first",
)
def grid_aggregates(spark, d):
    quartiles = F.percentile("z", F.array(F.lit(0.25), F.lit(0.75)))
    return metrics.grid_aggregates(
        point_view(spark, d), 20.0, spread=quartiles[1] - quartiles[0], high_first=F.avg(F.when((F.col("return_number") == 1) & (F.col("z") > 10), 1.0).otherwise(0.0)), trees=F.count_distinct("tree_id")
    )


@query(
    """SELECT shot_id, cos(radians(30)) * ux - sin(radians(30)) * uy AS dx, sin(radians(30)) * ux + cos(radians(30)) * uy AS dy, uz AS dz FROM (SELECT shot_id, sin(radians(zenith)) * sin(radians(azimuth)) AS ux, sin(radians(zenith)) * cos(radians(azimuth)) AS uy, cos(radians(zenith)) AS uz FROM shots)""",
    "dx dy dz",
)
def transform_vectors(spark, d):
    s = shots(spark, d).withColumns(pulses.direction(F.col("zenith"), F.col("azimuth")))
    return ops.transform_vectors(s.select("shot_id", "dx", "dy", "dz"), ops.translation(5.0, 1.0, 2.0) @ ops.rotation_z(30.0), ("dx", "dy", "dz"))


@query("SELECT id AS id_a, id AS id_b FROM centres WHERE id % 9 <> 0")
def match_targets(spark, d):
    """Targets of two scans, one turned, moved and thinned; a supplier's balance is its target's height."""
    a = centres(spark, d).select("id", "x", "y", (F.col("value") / 1000).alias("z"))
    b = ops.transform(a.filter("id % 9 <> 0"), ops.translation(-4.0, 11.0, 0.5) @ ops.rotation_z(-73.0))
    return targets.match_targets(a, b, 0.02, 0.01)[1].select("id_a", "id_b")
