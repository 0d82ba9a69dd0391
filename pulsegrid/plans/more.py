"""Queries of ground, trees, voxels, graphs, polygons and fits."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..operators import canopy, fit, graph, ground, neighbours, pulses, raster, trees, voxels
from ..operators.polygons import polygon_join
from ..streaming import aggregates
from .catalog import BOX, CHM, query
from .paths import SHORTEST
from .views import centres, later_points, shots, table
from .views import points as point_view

# --- ground -----------------------------------------------------------------


def pmf_sql(size: float, windows: list[tuple[int, float]], last: float) -> str:
    parts = [f"s0 AS (SELECT CAST(floor(y / {size}) AS BIGINT) AS row, CAST(floor(x / {size}) AS BIGINT) AS col, min(z) AS value FROM p GROUP BY 1, 2)"]
    for i, (w, limit) in enumerate(windows):
        parts.append(BOX.format(n=f"lo{i}", f="min", t=f"s{i}", w=w))
        parts.append(BOX.format(n=f"hi{i}", f="max", t=f"lo{i}", w=w))
        parts.append(f"s{i + 1} AS (SELECT row, col, CASE WHEN s.value - h.value > {limit}::DOUBLE THEN h.value ELSE s.value END AS value FROM s{i} s JOIN hi{i} h USING (row, col))")
    n = len(windows)
    return f"WITH {', '.join(parts)} SELECT pid, coalesce(z - s.value <= {last}::DOUBLE, false) AS ground FROM p LEFT JOIN s{n} s ON s.row = floor(p.y / {size}) AND s.col = floor(p.x / {size})"


@query(pmf_sql(4.0, [(1, 1.35), (2, 2.0)], 0.15 + 0.3 * 4.0))
def progressive_morphology(spark, d):
    return ground.progressive_morphology(point_view(spark, d), size=4.0, max_window=20.0).select("pid", "ground")


@query()
def cloth_simulation(spark, d):
    return ground.cloth_simulation(point_view(spark, d), size=2.0, tile=40.0, buffer=10.0).select("pid", "ground")


#: Gaps are filled ring by ring: of a cell's neighbours that are one step nearer to data, the first in row order gives its value.
TERRAIN = """WITH RECURSIVE low AS (SELECT CAST(floor(y / 1.0) AS BIGINT) AS row, CAST(floor(x / 1.0) AS BIGINT) AS col, min(z) AS value FROM p WHERE classification = 2 GROUP BY 1, 2),
    every AS (SELECT r.row, c.col FROM (SELECT unnest(generate_series((SELECT min(row) FROM low), (SELECT max(row) FROM low))) AS row) r, (SELECT unnest(generate_series((SELECT min(col) FROM low), (SELECT max(col) FROM low))) AS col) c),
    far AS (SELECT e.row, e.col, min(abs(e.row - l.row) + abs(e.col - l.col)) AS steps FROM every e, low l GROUP BY 1, 2),
    whole AS (SELECT row, col, value, 0::BIGINT AS steps FROM low
      UNION ALL SELECT f.row, f.col, arg_min(w.value, (w.row, w.col)) AS value, f.steps FROM whole w JOIN far f ON f.steps = w.steps + 1 AND abs(f.row - w.row) + abs(f.col - w.col) = 1 GROUP BY f.row, f.col, f.steps),
    mean AS (SELECT a.row, a.col, avg(b.value) AS value FROM whole a JOIN whole b ON b.row BETWEEN a.row - 2 AND a.row + 2 AND b.col BETWEEN a.col - 2 AND a.col + 2 GROUP BY 1, 2)
    SELECT w.row, w.col, CASE WHEN w.steps = 0 THEN w.value ELSE m.value END AS value FROM whole w JOIN mean m USING (row, col)"""


@query(TERRAIN, "value")
def terrain(spark, d):
    return ground.terrain(point_view(spark, d).filter("classification = 2"), 1.0)


# --- trees ------------------------------------------------------------------


@query(
    f"""WITH r AS ({CHM}), t AS (SELECT a.row, a.col, a.value FROM r a WHERE a.value >= 20 AND NOT EXISTS (SELECT 1 FROM r b WHERE (b.row - a.row) * (b.row - a.row) * 4.0 + (b.col - a.col) * (b.col - a.col) * 4.0 <= 16.0
    AND (b.row <> a.row OR b.col <> a.col) AND (b.value > a.value OR b.value = a.value AND (b.col < a.col OR b.col = a.col AND b.row < a.row)) AND b.value >= 20))
    SELECT row_number() OVER (ORDER BY col, row) - 1 AS tree_id, row, col, (col + 0.5::DOUBLE) * 2 AS x, (row + 0.5::DOUBLE) * 2 AS y, value AS height FROM t""",
    "x y height",
)
def tree_tops(spark, d):
    return trees.tree_tops(raster.rasterize(point_view(spark, d), 2.0, reduce="max"), 2.0, 8.0, 20.0)


def crowns(spark, d, method):
    canopy = raster.rasterize(point_view(spark, d), 2.0, reduce="max")
    tops = trees.tree_tops(canopy, 2.0, 8.0, 20.0)
    return trees.crowns(canopy, tops, 2.0, method, least=10.0, widest=20.0, tile=50.0, buffer=20.0)


@query()
def watershed_crowns(spark, d):
    return crowns(spark, d, "watershed")


@query()
def grown_crowns(spark, d):
    return crowns(spark, d, "grow")


@query()
def crown_metrics(spark, d):
    return trees.crown_metrics(point_view(spark, d))


@query(
    """WITH m AS (SELECT tree_id, avg(x) AS mx, avg(y) AS my FROM p GROUP BY 1), q AS (SELECT tree_id, mx, my, x - mx AS u, y - my AS v FROM p JOIN m USING (tree_id)),
    s AS (SELECT tree_id, mx, my, count(*) AS n, sum(u*u) AS uu, sum(v*v) AS vv, sum(u*v) AS uv, sum(u*u*u) AS uuu, sum(v*v*v) AS vvv, sum(u*v*v) AS uvv, sum(v*u*u) AS vuu FROM q GROUP BY 1, 2, 3),
    c AS (SELECT *, ((uuu + uvv) / 2 * vv - (vvv + vuu) / 2 * uv) / (uu * vv - uv * uv) AS cu, ((vvv + vuu) / 2 * uu - (uuu + uvv) / 2 * uv) / (uu * vv - uv * uv) AS cv FROM s)
    SELECT tree_id, n, mx + cu AS x, my + cv AS y, sqrt(cu * cu + cv * cv + (uu + vv) / n) AS radius FROM c""",
    "x y radius",
)
def circle_fit(spark, d):
    return trees.circle_fit(point_view(spark, d), "tree_id")


# --- voxels -----------------------------------------------------------------


def rays(spark, d, upright: bool):
    """Pulses from above; upright ones go straight down, the others by their angles."""
    s = shots(spark, d)
    angles = pulses.direction(F.lit(0.0) if upright else F.col("zenith") / 3.0, F.col("azimuth"))
    s = s.withColumns(angles).withColumn("dz", -F.col("dz"))
    ranges = F.sort_array(F.transform("echoes", lambda e: F.lit(40.25) - e["height"]))
    return s.select("ox", "oy", F.lit(40.25).alias("oz"), "dx", "dy", "dz", F.lit(40.0).alias("reach"), ranges.alias("ranges"))


@query(
    """WITH r AS (SELECT shot_id, CAST(floor(ox / 2) AS BIGINT) AS ix, CAST(floor(oy / 2) AS BIGINT) AS iy, list_sort(list_transform(echoes, lambda e: 40.25::DOUBLE - e.height)) AS g FROM shots),
    f AS (SELECT *, CASE WHEN len(g) > 0 THEN g[len(g)] ELSE 40.0::DOUBLE END AS far, CASE WHEN len(g) > 0 THEN g[1] END AS near FROM r),
    v AS (SELECT ix, iy, iz, far, near, greatest(40.25::DOUBLE - (iz + 1) * 2, 0) AS enter, least(40.25::DOUBLE - iz * 2, far) AS leave FROM f, (SELECT unnest(generate_series(0, 20)) AS iz)),
    w AS (SELECT ix, iy, iz, count(*)::DOUBLE AS rays, sum(leave - enter) AS path, sum(greatest(least(leave, coalesce(near, 1e9)) - enter, 0)) AS free_path,
      (count(*) FILTER (near > enter AND near <= leave))::DOUBLE AS intercepted FROM v WHERE leave > enter GROUP BY 1, 2, 3),
    h AS (SELECT ix, iy, CAST(floor((40.25::DOUBLE - e) / 2) AS BIGINT) AS iz, count(*)::DOUBLE AS hits FROM (SELECT ix, iy, unnest(g) AS e FROM f) GROUP BY 1, 2, 3)
    SELECT ix, iy, iz, coalesce(rays, 0) AS rays, coalesce(hits, 0) AS hits, coalesce(path, 0) AS path, coalesce(free_path, 0) AS free_path, coalesce(intercepted, 0) AS intercepted FROM w FULL JOIN h USING (ix, iy, iz)""",
    "rays hits path free_path intercepted",
)
def trace_upright(spark, d):
    return voxels.trace(rays(spark, d, True).withColumn("dx", F.lit(0.0)).withColumn("dy", F.lit(0.0)), 2.0)


def cuts_sql(axis: str) -> str:
    """Where each ray meets the grid planes of an axis, as shares of its length."""
    o, e = f"o{axis}", f"e{axis}"
    first, last = f"CAST(floor(least({o}, {e}) / 2) AS BIGINT) + 1", f"CAST(ceil(greatest({o}, {e}) / 2) AS BIGINT) - 1"
    return f"SELECT shot_id, (k * 2 - {o}) / ({e} - {o}) AS t FROM (SELECT *, unnest(generate_series({first}, {last})) AS k FROM f)"


#: A ray's voxels, told by the middles of the pieces between the planes that it meets.
TRACE = f"""WITH s AS (SELECT shot_id, ox, oy, 40.25::DOUBLE AS oz, sin(radians(zenith / 3)) * sin(radians(azimuth)) AS dx, sin(radians(zenith / 3)) * cos(radians(azimuth)) AS dy, -cos(radians(zenith / 3)) AS dz,
      list_sort(list_transform(echoes, lambda e: 40.25::DOUBLE - e.height)) AS g FROM shots),
    f AS (SELECT *, ox + dx * reach AS ex, oy + dy * reach AS ey, oz + dz * reach AS ez FROM (SELECT *, CASE WHEN len(g) > 0 THEN g[len(g)] ELSE 40.0::DOUBLE END AS reach, g[1] AS near FROM s)),
    t AS (SELECT shot_id, 0.0::DOUBLE AS t FROM f UNION ALL SELECT shot_id, 1.0::DOUBLE FROM f UNION ALL {cuts_sql("x")} UNION ALL {cuts_sql("y")} UNION ALL {cuts_sql("z")}),
    c AS (SELECT shot_id, t AS a, lead(t) OVER (PARTITION BY shot_id ORDER BY t) AS b FROM t),
    v AS (SELECT CAST(floor((ox + (ex - ox) * ((a + b) / 2)) / 2) AS BIGINT) AS ix, CAST(floor((oy + (ey - oy) * ((a + b) / 2)) / 2) AS BIGINT) AS iy, CAST(floor((oz + (ez - oz) * ((a + b) / 2)) / 2) AS BIGINT) AS iz,
      a * reach AS enter, b * reach AS leave, near FROM c JOIN f USING (shot_id) WHERE b > a),
    w AS (SELECT ix, iy, iz, count(*)::DOUBLE AS rays, sum(leave - enter) AS path, sum(greatest(least(leave, coalesce(near, 1e9)) - enter, 0)) AS free_path FROM v GROUP BY 1, 2, 3),
    h AS (SELECT CAST(floor((ox + dx * e) / 2) AS BIGINT) AS ix, CAST(floor((oy + dy * e) / 2) AS BIGINT) AS iy, CAST(floor((oz + dz * e) / 2) AS BIGINT) AS iz, count(*)::DOUBLE AS hits, (count(*) FILTER (i = 1))::DOUBLE AS intercepted
      FROM (SELECT *, unnest(g) AS e, unnest(generate_series(1, len(g))) AS i FROM f) GROUP BY 1, 2, 3)
    SELECT ix, iy, iz, coalesce(rays, 0) AS rays, coalesce(hits, 0) AS hits, coalesce(path, 0) AS path, coalesce(free_path, 0) AS free_path, coalesce(intercepted, 0) AS intercepted FROM w FULL JOIN h USING (ix, iy, iz)"""
DENSITIES = f"""SELECT *, intercepted / nullif(free_path, 0) AS contact, CASE WHEN path / nullif(rays, 0) > 0 THEN -ln(greatest(1 - intercepted / rays, 0.5 / rays)) / (path / rays) END AS transmittance,
    CASE WHEN rays > 1 THEN intercepted / nullif(free_path, 0) / 0.5 END AS pad, CASE WHEN rays > 1 AND path > 0 THEN 2.0 * (rays - 1) / rays * hits / path END AS pad_unbiased FROM ({TRACE})"""


@query(TRACE, "rays hits path free_path intercepted")
def trace_rays(spark, d):
    return voxels.trace(rays(spark, d, False), 2.0)


@query(DENSITIES, "rays hits path free_path intercepted contact transmittance pad pad_unbiased")
def voxel_densities(spark, d):
    return voxels.densities(voxels.trace(rays(spark, d, False), 2.0), 2.0)


@query(f"SELECT iz, avg(pad) AS pad, count(pad) AS n, (iz + 0.5::DOUBLE) * 2 AS height FROM ({DENSITIES}) GROUP BY iz", "pad height")
def voxel_profile(spark, d):
    return voxels.vertical_profile(voxels.densities(voxels.trace(rays(spark, d, False), 2.0), 2.0), 2.0)


@query(
    f"""SELECT iz, coalesce(o, 0) AS observed, 1 - coalesce(o, 0) / 2500.0::DOUBLE AS occluded FROM (SELECT unnest(generate_series(0, 14)) AS iz)
    LEFT JOIN (SELECT iz, count(*) AS o FROM ({TRACE}) WHERE ix BETWEEN 0 AND 49 AND iy BETWEEN 0 AND 49 AND iz BETWEEN 0 AND 14 AND rays >= 1 GROUP BY 1) USING (iz)""",
    "occluded",
)
def occlusion(spark, d):
    return voxels.occlusion(voxels.trace(rays(spark, d, False), 2.0), (0, 49, 0, 49, 0, 14), 1.0)


# --- graphs -----------------------------------------------------------------


@query(
    """WITH RECURSIVE v AS (SELECT pid, x, y, z FROM p WHERE z > 29.0),
    e AS (SELECT a.pid AS s, b.pid AS d FROM v a, v b WHERE a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1.0),
    r AS (SELECT pid, pid AS c FROM v UNION SELECT e.d, r.c FROM r JOIN e ON e.s = r.pid), m AS (SELECT pid, min(c) AS c FROM r GROUP BY 1)
    SELECT pid, CASE WHEN count(*) OVER (PARTITION BY c) >= 3 THEN c ELSE -1 END AS cluster FROM m"""
)
def clusters(spark, d):
    return graph.clusters(point_view(spark, d).filter("z > 29.0"), 1.0, 3)


#: Each point takes the least label among those it is linked to, until no label falls.
CLUSTERS_WHOLE = """WITH RECURSIVE e AS (SELECT a.pid AS s, b.pid AS d FROM (SELECT *, floor(x) AS cx, floor(y) AS cy, floor(z) AS cz FROM p) a,
      (SELECT *, floor(x) + i AS cx, floor(y) + j AS cy, floor(z) + k AS cz FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) b
      WHERE a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 1.0),
    r(pid, c) USING KEY (pid) AS (SELECT pid, pid FROM p UNION
      SELECT e.d, min(r.c) FROM r JOIN e ON e.s = r.pid JOIN recurring.r k ON k.pid = e.d WHERE r.c < k.c GROUP BY e.d)
    SELECT pid, CASE WHEN count(*) OVER (PARTITION BY c) >= 3 THEN c ELSE -1 END AS cluster FROM r"""


@query(CLUSTERS_WHOLE)
def clusters_whole(spark, d):
    """Clusters of every point; the SQL of ``clusters`` holds the upper ones alone."""
    return graph.clusters(point_view(spark, d), 1.0, 3)


@query(
    """WITH RECURSIVE v AS (SELECT row, col FROM (SELECT CAST(floor(y / 2.0) AS BIGINT) AS row, CAST(floor(x / 2.0) AS BIGINT) AS col, max(z) AS m FROM p GROUP BY 1, 2) WHERE m <= 26.0),
    r AS (SELECT row, col, row AS r0, col AS c0 FROM v UNION SELECT v.row, v.col, r.r0, r.c0 FROM r JOIN v ON abs(v.row - r.row) + abs(v.col - r.col) = 1),
    m AS (SELECT row, col, min((r0, c0)) AS g FROM r GROUP BY 1, 2)
    SELECT (g[1] + 1073741824) * 2147483648 + g[2] + 1073741824 AS gap, count(*) AS n, count(*) * 4.0::DOUBLE AS area, avg(row) AS row, avg(col) AS col FROM m GROUP BY g HAVING count(*) >= 2""",
    "area row col",
)
def canopy_gaps(spark, d):
    return graph.canopy_gaps(raster.rasterize(point_view(spark, d), 2.0, reduce="max"), 2.0, 26.0, least=8.0)


@query(SHORTEST, "dist")
def shortest_paths(spark, d):
    """Ways along near points from the ground to every point that they reach."""
    p = point_view(spark, d)
    return graph.near_paths(p, 1.5, p.filter("classification = 2").select("pid")).drop("pred")


# --- polygons ---------------------------------------------------------------


@query(
    """SELECT pid, id AS feature FROM p JOIN centres c ON (p.y - c.y) >= -3.003 AND (p.y - c.y) <= 3.003 AND abs(p.x - c.x) <= (3.003 - (p.y - c.y)) / 2 AND NOT (abs(p.x - c.x) < 0.503 AND abs(p.y - c.y) < 0.503)"""
)
def polygon_join_query(spark, d):
    """Triangles around the centres, each with a square hole whose edge belongs to it."""
    c = centres(spark, d)

    def ring(*corners):
        return F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in corners])

    shapes = c.select(F.col("id").alias("feature"), F.array(ring((-3.003, -3.003), (3.003, -3.003), (0, 3.003)), ring((-0.503, -0.503), (0.503, -0.503), (0.503, 0.503), (-0.503, 0.503))).alias("rings"))
    return polygon_join(point_view(spark, d).select("pid", "x", "y"), shapes, 5.0).select("pid", "feature")


# --- fits -------------------------------------------------------------------


@query(
    """WITH s AS (SELECT tree_id, avg(z) AS h, avg(intensity) AS i, count(*)::DOUBLE AS n FROM p GROUP BY 1)
    SELECT tree_id, regr_intercept(h, i) OVER () + regr_slope(h, i) OVER () * i AS predicted FROM s""",
    "predicted",
)
def upscale_linear(spark, d):
    s = point_view(spark, d).groupBy("tree_id").agg(F.avg("z").alias("h"), F.avg("intensity").alias("i"))
    return fit.Linear(s, "h", ["i"]).predict(s).select("tree_id", "predicted")


@query(
    """WITH s AS (SELECT tree_id, ln(avg(z)) AS y, ln(avg(intensity)) AS u, ln(avg(x)) AS v FROM p GROUP BY 1),
    m AS (SELECT count(*) AS n, avg(y) AS my, avg(u) AS mu, avg(v) AS mv, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy FROM s),
    b AS (SELECT *, uu * vv - uv * uv AS det, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS b, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS c FROM m)
    SELECT tree_id, (y - my - b * (u - mu) - c * (v - mv)) / (1 - 1 / n - ((u - mu) * (u - mu) * vv - 2 * (u - mu) * (v - mv) * uv + (v - mv) * (v - mv) * uu) / (n * det)) AS loo FROM s, b""",
    "loo",
)
def upscale_leave_one_out(spark, d):
    s = point_view(spark, d).groupBy("tree_id").agg(F.avg("z").alias("h"), F.avg("intensity").alias("i"), F.avg("x").alias("x"))
    return fit.Linear(s, "h", ["i", "x"], log=True).leave_one_out(s).select("tree_id", "loo")


@query(
    """SELECT i AS row, j AS col, CASE WHEN i = j AND i < 2 THEN cos(radians(12)) WHEN i = 0 AND j = 1 THEN -sin(radians(12)) WHEN i = 1 AND j = 0 THEN sin(radians(12)) WHEN i = j THEN 1
      WHEN j = 3 THEN [2.0, -1.0, 0.5][i + 1] ELSE 0 END::DOUBLE AS value FROM (SELECT unnest(generate_series(0, 3))::INT AS i), (SELECT unnest(generate_series(0, 3))::INT AS j)""",
    "value",
)
def rigid_registration(spark, d):
    """Pairs of points of two epochs give back the move between them."""
    from ..operators.points import rotation_z, transform, translation

    p = point_view(spark, d)
    m = translation(2.0, -1.0, 0.5) @ rotation_z(12.0)
    b = transform(p, m).select("pid", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    pairs = p.select("pid", *[F.col(c).alias(f"a{c}") for c in "xyz"]).join(b, "pid")
    found = fit.rigid(pairs)
    return spark.createDataFrame([(i, j, float(v)) for (i, j), v in np.ndenumerate(found)], "row int, col int, value double")


@query()
def match_trees(spark, d):
    a = centres(spark, d).select("id", "x", "y", (F.abs("value") / 500.0).alias("height"))
    b = a.withColumns({"x": F.col("x") + 0.2, "y": F.col("y") - 0.1, "height": F.col("height") + 0.3}).filter("id % 7 <> 0")
    return fit.match_trees(a, b, 1.0)


def sampled(pulses):
    """``wf_id, samples``: 80 samples of a pulse, an echo at each of its ``heights``."""

    def run(batches):
        i = np.arange(80.0)
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                lists = part.column(1)
                n = lists.value_lengths().to_numpy(zero_copy_only=False)
                at = lists.flatten().to_numpy(zero_copy_only=False)
                off = i - at[:, None] * 2.0 - 8.0
                waves = np.add.reduceat(40.0 * np.exp(-(off * off) / 8.0), np.cumsum(n) - n, axis=0)
                held = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype="i4") * 80), pa.array(waves.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), held], names=["wf_id", "samples"])

    return pulses.mapInArrow(run, "wf_id long, samples array<double>")


@query()
def waveform_echoes(spark, d):
    """Each pulse's echoes as a sampled waveform, taken apart again."""
    s = shots(spark, d).filter("size(echoes) > 0")
    return fit.decompose(sampled(s.select(F.col("shot_id").alias("wf_id"), F.transform("echoes", lambda e: e["height"]).alias("heights"))))




# --- streams ----------------------------------------------------------------


@query("SELECT CAST(floor(y / 10.0) AS BIGINT) AS row, CAST(floor(x / 10.0) AS BIGINT) AS col, count(*) AS n, sum(z) AS sum, min(z) AS low, max(z) AS high FROM p GROUP BY 1, 2", "sum low high")
def stream_grid(spark, d):
    return aggregates.grid(point_view(spark, d), 10.0)


@query(
    """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOUR AS "end", count(*) AS n, sum(value) AS total FROM (
    SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s""",
    "total",
)
def stream_sessions(spark, d):
    return aggregates.pulse_sessions(table(spark, d, "events"), "user_id", "6 hours", "1 day")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY AS \"end\", event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL", "total")
def stream_windows(spark, d):
    return aggregates.windowed(table(spark, d, "events"), "1 day", None, "1 day")


# --- canopy and plots -------------------------------------------------------


@query("SELECT avg(CASE WHEN top > 20 THEN 1.0::DOUBLE ELSE 0 END) AS cover, count(*) AS cells FROM (SELECT max(z) AS top FROM p GROUP BY floor(x / 1.0), floor(y / 1.0))", "cover")
def canopy_cover(spark, d):
    return canopy.cover(point_view(spark, d), 1.0, 20.0)


@query("SELECT layer, n, n / sum(n) OVER () AS share FROM (SELECT CAST(floor(z / 2.0) AS BIGINT) AS layer, count(*) AS n FROM p GROUP BY 1)", "share")
def vertical_profile(spark, d):
    return canopy.vertical_profile(point_view(spark, d), 2.0)


@query("SELECT CAST(floor(x / 5.0) AS BIGINT) AS ix, CAST(floor(y / 5.0) AS BIGINT) AS iy, CAST(floor(z / 5.0) AS BIGINT) AS iz, count(*) / 125.0::DOUBLE AS density, count(*) FILTER (return_number = 1) / count(*) AS first_share FROM p GROUP BY 1, 2, 3", "density first_share")
def density_grid(spark, d):
    return canopy.density_grid(point_view(spark, d), 5.0)


@query(
    """WITH s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, var_pop(z) AS zz FROM p WHERE classification = 2),
    t AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS b, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS c FROM s)
    SELECT n, mz - b * mx - c * my AS a, b, c, sqrt(zz - b * xz - c * yz) AS sd FROM t""",
    "a b c sd",
)
def ground_plane(spark, d):
    return canopy.ground_plane(point_view(spark, d).filter("classification = 2"))


@query("SELECT CAST(floor(zenith / 5.0) AS BIGINT) AS ring, count(*) AS fired, count(*) FILTER (len(echoes) > 0) AS returned, sum(len(echoes))::BIGINT AS echoes, sum(len(echoes)) / count(*) FILTER (len(echoes) > 0) AS per_return FROM shots GROUP BY 1", "per_return")
def fired_pulses(spark, d):
    return canopy.fired_pulses(shots(spark, d))


@query(
    """SELECT CAST(floor(32 - 32 * (zenith / 90.0::DOUBLE) * cos(radians(azimuth))) AS BIGINT) AS row, CAST(floor(32 + 32 * (zenith / 90.0::DOUBLE) * sin(radians(azimuth))) AS BIGINT) AS col, count(*) AS pulses,
    count(*) FILTER (len(list_filter(echoes, lambda e: e.height > 20.0)) = 0) AS gaps, count(*) FILTER (len(list_filter(echoes, lambda e: e.height > 20.0)) = 0) / count(*) AS value FROM shots WHERE zenith BETWEEN 0 AND 90 GROUP BY 1, 2""",
    "value",
)
def hemispherical_picture(spark, d):
    return canopy.hemisphere(shots(spark, d), 64, 20.0)


@query("SELECT pid, arg_min(s.id, ((x - s.ox) * (x - s.ox) + (y - s.oy) * (y - s.oy) + (z - s.oz) * (z - s.oz), s.id)) AS scan_id FROM p, (SELECT id, x AS ox, y AS oy, 2.0::DOUBLE AS oz FROM centres WHERE id < 5) s GROUP BY 1")
def scan_ids(spark, d):
    o = centres(spark, d).filter("id < 5").select(F.col("id").alias("scan_id"), "x", "y", F.lit(2.0).alias("z"))
    return canopy.scan_ids(point_view(spark, d), o).select("pid", "scan_id")


@query("SELECT pid, arg_min(s.id, ((s.x - p.x) * (s.x - p.x) + (s.y - p.y) * (s.y - p.y) + (2.0 - p.z) * (2.0 - p.z), s.id)) AS scan_id FROM p, centres s GROUP BY 1")
def scan_ids_whole(spark, d):
    """The nearest of all origins; the SQL of ``scan_ids`` holds five alone."""
    o = centres(spark, d).select(F.col("id").alias("pid"), "x", "y", F.lit(2.0).alias("z"))
    q = point_view(spark, d).select(F.col("pid").alias("id"), "x", "y", "z")
    return neighbours.nearest_by_cells(q, o, 4.0, 200.0).select(F.col("id").alias("pid"), F.col("pid").alias("scan_id"))


PLOT_TREES = "SELECT id AS tree_id, abs(value) / 21000.0::DOUBLE AS dbh, abs(value) / 310.0::DOUBLE AS height FROM centres"


def plot_trees(spark, d):
    return centres(spark, d).select(F.col("id").alias("tree_id"), (F.abs("value") / 21000.0).alias("dbh"), (F.abs("value") / 310.0).alias("height"))


@query(
    f"""WITH t AS ({PLOT_TREES}) SELECT count(*) / 2500.0::DOUBLE * 10000 AS stems_ha, sum(pi() * dbh * dbh / 4) / 2500.0::DOUBLE * 10000 AS basal_area, avg(dbh) AS mean_dbh, sqrt(avg(dbh * dbh)) AS quadratic_dbh, avg(height) AS mean_height,
    (SELECT avg(height) FROM (SELECT height FROM t ORDER BY height DESC, tree_id LIMIT 25)) AS dominant_height FROM t""",
    "stems_ha basal_area mean_dbh quadratic_dbh mean_height dominant_height",
)
def plot_summary(spark, d):
    return canopy.plot_summary(plot_trees(spark, d), 2500.0)


@query(
    f"""WITH t AS ({PLOT_TREES}), q AS (SELECT tree_id, dbh AS dbh_a, height AS height_a, dbh + (tree_id % 5 - 1) / 100.0::DOUBLE AS dbh_b, height + (tree_id % 3) / 10.0::DOUBLE AS height_b FROM t)
    SELECT *, (dbh_b - dbh_a) / 4.0::DOUBLE AS dbh_rate, (height_b - height_a) / 4.0::DOUBLE AS height_rate, dbh_b - dbh_a > 1.96 * sqrt(2) * 0.0031 AS grown, dbh_b - dbh_a < -1.96 * sqrt(2) * 0.0031 AS shrunk FROM q""",
    "dbh_a height_a dbh_b height_b dbh_rate height_rate",
)
def tree_increments(spark, d):
    t = plot_trees(spark, d).select("tree_id", F.col("dbh").alias("dbh_a"), F.col("height").alias("height_a"))
    t = t.withColumns({"dbh_b": F.col("dbh_a") + (F.col("tree_id") % 5 - 1) / F.lit(100.0), "height_b": F.col("height_a") + (F.col("tree_id") % 3) / F.lit(10.0)})
    return canopy.tree_increments(t, 4.0, se=0.0031)


@query(
    """WITH a AS (SELECT id, abs(value) AS height FROM centres WHERE id % 5 <> 1), b AS (SELECT id, abs(value) * (1 - (id % 4) / 8.0::DOUBLE) AS height FROM centres WHERE id % 7 <> 1)
    SELECT a.id AS id_a, b.id AS id_b, a.height AS height_a, b.height AS height_b, CASE WHEN b.id IS NULL THEN 'dead' WHEN a.id IS NULL THEN 'recruit' WHEN b.height < 0.8 * a.height THEN 'damaged' ELSE 'survivor' END AS state FROM a FULL JOIN b USING (id)""",
    "height_a height_b",
)
def tree_states(spark, d):
    c = centres(spark, d)
    a = c.filter("id % 5 <> 1").select("id", F.abs("value").alias("height"))
    b = c.filter("id % 7 <> 1").select("id", (F.abs("value") * (1 - (F.col("id") % 4) / F.lit(8.0))).alias("height"))
    pairs = a.join(b, "id").select(F.col("id").alias("id_a"), F.col("id").alias("id_b"))
    return canopy.tree_states(a, b, pairs)


@query(
    f"""WITH a AS ({CHM}), b AS (SELECT CAST(floor(y / 2.0) AS BIGINT) AS row, CAST(floor(x / 2.0) AS BIGINT) AS col, max(z) AS value FROM later GROUP BY 1, 2),
    g AS (SELECT row, col, value, CASE WHEN lead(col) OVER r - lag(col) OVER r = 2 THEN (lead(value) OVER r - lag(value) OVER r) / 4.0::DOUBLE END AS gx,
      CASE WHEN lead(row) OVER c - lag(row) OVER c = 2 THEN (lead(value) OVER c - lag(value) OVER c) / 4.0::DOUBLE END AS gy FROM a WINDOW r AS (PARTITION BY row ORDER BY col), c AS (PARTITION BY col ORDER BY row)),
    j AS (SELECT g.value - b.value AS dz, gx, gy FROM g JOIN b USING (row, col) WHERE gx IS NOT NULL AND gy IS NOT NULL),
    m AS (SELECT count(*) AS n, avg(dz) AS d, avg(gx) AS mx, avg(gy) AS my, var_pop(gx) AS xx, var_pop(gy) AS yy, covar_pop(gx, gy) AS xy, covar_pop(gx, dz) AS xd, covar_pop(gy, dz) AS yd FROM j),
    t AS (SELECT *, -(xd * yy - yd * xy) / (xx * yy - xy * xy) AS tx, -(yd * xx - xd * xy) / (xx * yy - xy * xy) AS ty FROM m)
    SELECT n, tx, ty, d + mx * tx + my * ty AS tz FROM t""",
    "tx ty tz",
)
def survey_shift(spark, d):
    a, b = (raster.rasterize(f(spark, d), 2.0, reduce="max") for f in (point_view, later_points))
    return canopy.survey_shift(a, b, 2.0)


@query(
    """SELECT a, b, count(*) AS n, sqrt(min(d2)) AS nearest, avg(z) AS height FROM (
    SELECT u.tree_id AS a, v.tree_id AS b, v.z, (u.x - v.x) * (u.x - v.x) + (u.y - v.y) * (u.y - v.y) + (u.z - v.z) * (u.z - v.z) AS d2
    FROM (SELECT *, floor(x / 0.5) AS cx, floor(y / 0.5) AS cy, floor(z / 0.5) AS cz FROM p) u,
      (SELECT *, floor(x / 0.5) + i AS cx, floor(y / 0.5) + j AS cy, floor(z / 0.5) + k AS cz FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) v
    WHERE u.cx = v.cx AND u.cy = v.cy AND u.cz = v.cz AND u.tree_id < v.tree_id) WHERE d2 <= 0.25 GROUP BY 1, 2""",
    "nearest height",
)
def tree_contacts(spark, d):
    return trees.contacts(point_view(spark, d), 0.5)


@query()
def leaf_or_wood(spark, d):
    return canopy.leaf_or_wood(neighbours.shape(point_view(spark, d), 8, 2.0, 100.0))


@query()
def leaf_angles(spark, d):
    return canopy.leaf_angles(neighbours.shape(point_view(spark, d), 8, 1.0, 100.0))


@query()
def top_down_trees(spark, d):
    return trees.li_2012(point_view(spark, d), tile=25.0, buffer=10.0)


@query()
def normals_and_shapes(spark, d):
    return neighbours.shape(point_view(spark, d), 12, 1.0, 100.0)


#: Cells of 8 m hold the eight nearest of every point of the view.
OUTLIERS = """WITH n AS (SELECT a.pid, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS d,
      row_number() OVER (PARTITION BY a.pid ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z), b.pid) AS r FROM (SELECT *, floor(x / 8) AS cx, floor(y / 8) AS cy, floor(z / 8) AS cz FROM p) a,
      (SELECT *, floor(x / 8) + i AS cx, floor(y / 8) + j AS cy, floor(z / 8) + k AS cz FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) b
      WHERE a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND a.pid <> b.pid AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) <= 64.0),
    m AS (SELECT pid, avg(d) AS mean_distance FROM n WHERE r <= 8 GROUP BY 1)
    SELECT pid, mean_distance, mean_distance <= (SELECT avg(mean_distance) + 2 * stddev_pop(mean_distance) FROM m) AS keep FROM m"""


@query(OUTLIERS, "mean_distance")
def statistical_outliers(spark, d):
    return neighbours.statistical_outliers(point_view(spark, d), 8, 2.0, start=1.0, limit=200.0).select("pid", "mean_distance", "keep")


@query()
def icp_registration(spark, d):
    """The move between an epoch and its turned copy, found again from nearest points."""
    from ..operators.points import rotation_z, transform, translation

    p = point_view(spark, d)
    m = translation(0.05, -0.03, 0.02) @ rotation_z(0.05, (50, 50, 0))
    found, rmse, n = fit.icp(p, transform(p, m), 1.0)
    return spark.createDataFrame([(i, j, float(v), rmse, n) for (i, j), v in np.ndenumerate(found)], "row int, col int, value double, rmse double, rounds int")
