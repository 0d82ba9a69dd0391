"""Registry of the engine's queries and their SQL counterparts.

Every entry applies one operator to a view of the test tables.  Doubles are
rounded to six places on both sides, since sums differ in their last bits with
the order of the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import cell
from ..operators import change, metrics, neighbours, points, pulses, raster
from .views import CENTRES_SQL, LATER_SQL, POINTS_SQL, SHOTS_SQL, TRACK_SQL, centres, later_points, shots, track
from .views import points as point_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[(F.round(c, places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = ""):
    """Register the decorated function under its own name, and its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
        if sql is not None:
            names = doubles.split()
            replace = f"REPLACE ({', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in names)})" if names else ""
            ORACLES[fn.__name__] = f"WITH p AS ({POINTS_SQL}), later AS ({LATER_SQL}), centres AS ({CENTRES_SQL}), track AS ({TRACK_SQL}), shots AS ({SHOTS_SQL}) SELECT * {replace} FROM ({sql})"
        return fn

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import forest, more, scanning, stored, wider  # noqa: F401  registers further queries

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import forest, more, scanning, stored, wider  # noqa: F401

    return dict(ORACLES)


P = "pid, x, y, z, intensity, return_number, classification, pulse, tree_id"


# --- points -----------------------------------------------------------------


@query(f"SELECT {P} FROM p WHERE classification NOT IN (2, 7) AND (z > 12.5 OR intensity >= 4000) AND return_number <= 3")
def filter_where(spark, d):
    return points.where(point_view(spark, d), "classification not in (2, 7) and (z > 12.5D or intensity >= 4000) and return_number <= 3")


@query(f"SELECT {P} FROM p WHERE x BETWEEN 20 AND 40 AND y >= 30 AND z <= 20")
def crop_box(spark, d):
    return points.crop_box(point_view(spark, d), (20, 30, None), (40, None, 20))


@query(f"SELECT {P} FROM p WHERE (x - 50) * (x - 50) + (y - 50) * (y - 50) <= 100 AND z >= 5")
def crop_cylinder(spark, d):
    return points.crop_cylinder(point_view(spark, d), 50.0, 50.0, 10.0, low=5.0)


@query(f"SELECT {P} FROM p WHERE sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50) + (z - 2) * (z - 2)) BETWEEN 10 AND 12.5")
def crop_range(spark, d):
    return points.crop_range(point_view(spark, d), (50.0, 50.0, 2.0), 10.0, 12.5)


@query(f"SELECT {P} FROM p ORDER BY md5(CAST(pid AS VARCHAR) || ':7'), pid LIMIT 500")
def random_points(spark, d):
    return points.random_points(point_view(spark, d), 500, seed=7)


@query(f"SELECT {P} FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 2.0), floor(y / 2.0), floor(z / 2.0) ORDER BY pid) AS r FROM p) WHERE r = 1")
def voxel_first(spark, d):
    return points.voxel_first(point_view(spark, d), 2.0)


@query("SELECT CAST(floor(x / 2.0) AS BIGINT) AS ix, CAST(floor(y / 2.0) AS BIGINT) AS iy, CAST(floor(z / 2.0) AS BIGINT) AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM p GROUP BY 1, 2, 3", "x y z")
def voxel_centroid(spark, d):
    return points.voxel_centroid(point_view(spark, d), 2.0)


@query(f"SELECT {P} FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 1.0), floor(y / 1.0) ORDER BY z DESC, pid) AS r FROM p) WHERE r = 1")
def decimate_highest(spark, d):
    return points.decimate_highest(point_view(spark, d), 1.0)


@query(
    f"""SELECT {P} FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 25.0), floor(y / 25.0) ORDER BY md5(CAST(pid AS VARCHAR) || ':0'), pid) AS r,
    count(*) OVER (PARTITION BY floor(x / 25.0), floor(y / 25.0)) AS n FROM p) WHERE r <= round(n * 0.3::DOUBLE)"""
)
def decimate_random(spark, d):
    return points.decimate_random(point_view(spark, d), 0.3, 25.0)


@query("SELECT pid, cos(radians(30)) * (x - 50) - sin(radians(30)) * (y - 50) + 50 + 1 AS x, sin(radians(30)) * (x - 50) + cos(radians(30)) * (y - 50) + 50 + 2 AS y, z - 3 AS z FROM p", "x y z")
def transform_points(spark, d):
    m = points.translation(1, 2, -3) @ points.rotation_z(30, (50, 50, 0))
    return points.transform(point_view(spark, d), m).select("pid", "x", "y", "z")


@query("SELECT pid, x, y, z, 0 AS scan_id FROM p UNION ALL SELECT pid, x, y, z, 1 FROM later", "x y z")
def merge_clouds(spark, d):
    return points.merge([point_view(spark, d).select("pid", "x", "y", "z", "pulse"), later_points(spark, d).select("pid", "x", "y", "z")])


@query("SELECT CAST(floor(x / 25.0) AS BIGINT) AS tx, CAST(floor(y / 25.0) AS BIGINT) AS ty, count(*) AS n FROM p GROUP BY 1, 2")
def retile(spark, d):
    return points.tiled(point_view(spark, d), 25.0).groupBy("tx", "ty").agg(F.count("*").alias("n"))


@query(
    """SELECT tx, ty, count(*) AS n, sum(CASE WHEN tx = floor(x / 25.0) AND ty = floor(y / 25.0) THEN 1 ELSE 0 END)::BIGINT AS core FROM (
    SELECT x, y, unnest(generate_series(CAST(floor((x - 2.0) / 25.0) AS BIGINT), CAST(floor((x + 2.0) / 25.0) AS BIGINT))) AS tx, ty
    FROM (SELECT x, y, unnest(generate_series(CAST(floor((y - 2.0) / 25.0) AS BIGINT), CAST(floor((y + 2.0) / 25.0) AS BIGINT))) AS ty FROM p)) GROUP BY 1, 2"""
)
def retile_buffered(spark, d):
    t = points.tiled(point_view(spark, d), 25.0, buffer=2.0)
    return t.groupBy("tx", "ty").agg(F.count("*").alias("n"), F.sum(F.col("core").cast("long")).alias("core"))


# --- rasters ----------------------------------------------------------------

RASTER = "SELECT CAST(floor(y / {s}) AS BIGINT) AS row, CAST(floor(x / {s}) AS BIGINT) AS col, {f} AS value FROM {t} GROUP BY 1, 2"
DTM = RASTER.format(s="5.0", f="min(z)", t="p")
CHM = RASTER.format(s="2.0", f="max(z)", t="p")


@query(RASTER.format(s="5.0", f="max(z)", t="p"), "value")
def rasterize_max(spark, d):
    return raster.rasterize(point_view(spark, d), 5.0, reduce="max")


@query(RASTER.format(s="5.0", f="min(z)", t="p"), "value")
def rasterize_min(spark, d):
    return raster.rasterize(point_view(spark, d), 5.0, reduce="min")


@query(RASTER.format(s="5.0", f="avg(z)", t="p"), "value")
def rasterize_mean(spark, d):
    return raster.rasterize(point_view(spark, d), 5.0, reduce="mean")


@query(RASTER.format(s="5.0", f="count(z)", t="p"))
def rasterize_count(spark, d):
    return raster.rasterize(point_view(spark, d), 5.0, reduce="count")


@query("SELECT row, col, CASE WHEN m >= 10 THEN m ELSE 0 END AS value FROM (SELECT CAST(floor(y / 1.0) AS BIGINT) AS row, CAST(floor(x / 1.0) AS BIGINT) AS col, max(z) AS m FROM p GROUP BY 1, 2)", "value")
def chm(spark, d):
    r = raster.rasterize(point_view(spark, d), 1.0, reduce="max")
    return r.withColumn("value", F.when(F.col("value") >= 10.0, F.col("value")).otherwise(0.0))


BOX = """{n} AS (SELECT a.row, a.col, {f}(b.value) AS value FROM {t} a JOIN {t} b ON b.row BETWEEN a.row - {w} AND a.row + {w} AND b.col BETWEEN a.col - {w} AND a.col + {w} GROUP BY 1, 2)"""


@query(f"WITH r AS ({DTM}), {BOX.format(n='lo', f='min', t='r', w=2)}, {BOX.format(n='hi', f='max', t='lo', w=2)} SELECT * FROM hi", "value")
def opening(spark, d):
    return raster.opening(raster.rasterize(point_view(spark, d), 5.0, reduce="min"), 2)


@query(f"WITH r AS ({DTM}), {BOX.format(n='m', f='avg', t='r', w=2)} SELECT * FROM m", "value")
def smooth(spark, d):
    return raster.smooth(raster.rasterize(point_view(spark, d), 5.0, reduce="min"), 2)


@query(
    f"""WITH r AS ({DTM}), n AS (SELECT a.row, a.col, a.value, """
    + ", ".join(f"coalesce(max(CASE WHEN b.row = a.row + {i // 3 - 1} AND b.col = a.col + {i % 3 - 1} THEN b.value END), a.value) AS v{i}" for i in range(9))
    + """ FROM r a JOIN r b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2, 3),
    s AS (SELECT row, col, (v2 + 2 * v5 + v8 - v0 - 2 * v3 - v6) / 40.0::DOUBLE AS dx, (v6 + 2 * v7 + v8 - v0 - 2 * v1 - v2) / 40.0::DOUBLE AS dy FROM n)
    SELECT row, col, greatest(sin(radians(45)) * cos(atan(sqrt(dx * dx + dy * dy))) + cos(radians(45)) * sin(atan(sqrt(dx * dx + dy * dy))) * cos(radians(315) - atan2(-dx, -dy)), 0) * 255.0::DOUBLE AS value FROM s""",
    "value",
)
def hillshade(spark, d):
    return raster.hillshade(raster.rasterize(point_view(spark, d), 5.0, reduce="min"), 5.0)


@query(
    f"""WITH r AS ({DTM}), b AS (SELECT min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM r),
    q AS (SELECT pid, z, least(greatest(x / 5.0 - 0.5, c0), c1)::DOUBLE AS u, least(greatest(y / 5.0 - 0.5, r0), r1)::DOUBLE AS v, r0, r1, c0, c1 FROM p, b),
    k AS (SELECT *, greatest(least(floor(u), c1 - 1), c0)::BIGINT AS cc, greatest(least(floor(v), r1 - 1), r0)::BIGINT AS rr FROM q)
    SELECT pid, z - (a.value * (1 - u + cc) * (1 - v + rr) + b1.value * (u - cc) * (1 - v + rr) + c.value * (1 - u + cc) * (v - rr) + e.value * (u - cc) * (v - rr)) AS height
    FROM k LEFT JOIN r a ON a.row = rr AND a.col = cc LEFT JOIN r b1 ON b1.row = rr AND b1.col = cc + 1 LEFT JOIN r c ON c.row = rr + 1 AND c.col = cc LEFT JOIN r e ON e.row = rr + 1 AND e.col = cc + 1""",
    "height",
)
def heights(spark, d):
    p = point_view(spark, d)
    ground = raster.rasterize(p, 5.0, reduce="min")
    return raster.bilinear(p, ground, 5.0).select("pid", (F.col("z") - F.col("ground")).alias("height"))


@query(
    f"""WITH r AS ({CHM}) SELECT a.row, a.col, a.value FROM r a WHERE a.value >= 20 AND NOT EXISTS (SELECT 1 FROM r b WHERE (b.row - a.row) * (b.row - a.row) * 4.0 + (b.col - a.col) * (b.col - a.col) * 4.0 <= 16.0
    AND (b.row <> a.row OR b.col <> a.col) AND (b.value > a.value OR b.value = a.value AND (b.col < a.col OR b.col = a.col AND b.row < a.row)) AND b.value >= 20)""",
    "value",
)
def local_maxima(spark, d):
    return raster.local_maxima(raster.rasterize(point_view(spark, d), 2.0, reduce="max"), 2.0, 8.0, 20.0)


@query(f"WITH r AS ({CHM}) SELECT p.pid FROM p JOIN r ON r.row = floor(p.y / 2.0) AND r.col = floor(p.x / 2.0) WHERE r.value BETWEEN 20 AND 28")
def raster_mask(spark, d):
    p = point_view(spark, d)
    r = raster.rasterize(p, 2.0, reduce="max").filter("value between 20 and 28")
    keyed = p.withColumns({"row": cell("y", 2.0), "col": cell("x", 2.0)})
    return keyed.join(r.select("row", "col"), ["row", "col"], "left_semi").select("pid")


# --- metrics ----------------------------------------------------------------

M = "zmax zmean zsd zskew zkurt zentropy pzabovezmean pzabove2 " + " ".join(f"zq{q}" for q in metrics.QUANTILES) + " " + " ".join(f"zpcum{k}" for k in range(1, 10)) + " cover gap_fraction itot imax imean isd iskew ikurt p1th p2th p3th p4th p5th pground"


def metrics_sql(source: str, key: str) -> str:
    """All metrics by ``key`` of ``source``, which names the points' own columns."""
    keys = [k.strip() for k in key.split(",")]
    using = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    skew = "(avg({v}*{v}*{v}) - 3*avg({v})*avg({v}*{v}) + 2*pow(avg({v}),3)) / pow(nullif(var_pop({v}), 0), 1.5)"
    q = ", ".join(f"quantile_cont(z, {n / 100}) AS zq{n}" for n in metrics.QUANTILES)
    cum = ", ".join(f"CASE WHEN max(b.zmax) <= 0 THEN 0.0 WHEN count(*) FILTER (a.z < b.zmax) > 0 THEN 100.0::DOUBLE * count(*) FILTER (a.z < b.zmax AND (a.z < 0 OR floor(a.z / (b.zmax / 10.0)) < {k})) / count(*) FILTER (a.z < b.zmax) ELSE 0.0 END AS zpcum{k}" for k in range(1, 10))
    pth = ", ".join(f"100.0::DOUBLE * count(*) FILTER (return_number = {k}) / count(*) AS p{k}th" for k in range(1, 6))
    return f"""
    WITH s AS (SELECT * FROM ({source}) WHERE classification NOT IN (7, 18)),
    b AS (SELECT {key}, count(*) AS n, max(z) AS zmax, avg(z) AS zmean, stddev_samp(z) AS zsd, {skew.format(v="(z - 15.0::DOUBLE)")} AS zskew,
      CASE WHEN count(*) > 1 AND var_pop(z) > 0 THEN kurtosis_pop(z) + 3 END AS zkurt, 100.0::DOUBLE * count(*) FILTER (z > 2) / count(*) AS pzabove2, min(z) AS low, {q},
      CASE WHEN count(*) FILTER (return_number = 1) > 0 THEN 100.0::DOUBLE * count(*) FILTER (return_number = 1 AND z > 2) / count(*) FILTER (return_number = 1) END AS cover,
      sum(intensity)::DOUBLE AS itot, max(intensity)::DOUBLE AS imax, avg(intensity) AS imean, stddev_samp(intensity) AS isd, {skew.format(v="(intensity - 2500.0::DOUBLE)")} AS iskew,
      CASE WHEN count(*) > 1 AND var_pop(intensity) > 0 THEN kurtosis_pop(intensity) + 3 END AS ikurt, {pth}, 100.0::DOUBLE * count(*) FILTER (classification = 2) / count(*) AS pground FROM s GROUP BY {key}),
    e AS (SELECT {key}, -sum(c / t * ln(c / t)) AS h FROM (
        SELECT {key}, c, sum(c) OVER (PARTITION BY {key}) AS t FROM (
          SELECT {", ".join("a." + k for k in keys)}, least(floor(a.z), greatest(ceil(b.zmax) - 1, 0)) AS bin, count(*)::DOUBLE AS c FROM s a JOIN b ON {using} GROUP BY ALL)) GROUP BY {key}),
    f AS (SELECT {", ".join("a." + k for k in keys)}, 100.0::DOUBLE * count(*) FILTER (a.z > b.zmean) / count(*) AS pzabovezmean, {cum} FROM s a JOIN b ON {using} GROUP BY {", ".join("a." + k for k in keys)})
    SELECT {", ".join("b." + k for k in keys)}, n, zmax, zmean, zsd, zskew, zkurt, CASE WHEN zmax >= 2 AND low >= 0 THEN h / ln(ceil(zmax)) END AS zentropy, pzabovezmean, pzabove2,
      {", ".join(f"zq{k}" for k in metrics.QUANTILES)}, {", ".join(f"zpcum{k}" for k in range(1, 10))}, cover, 1 - cover / 100 AS gap_fraction, itot, imax, imean, isd, iskew, ikurt, p1th, p2th, p3th, p4th, p5th, pground
    FROM b JOIN e ON {using.replace("a.", "e.")} JOIN f ON {using.replace("a.", "f.")}"""


@query(metrics_sql("SELECT *, CAST(floor(y / 20.0) AS BIGINT) AS row, CAST(floor(x / 20.0) AS BIGINT) AS col FROM p", "row, col"), M)
def grid_metrics(spark, d):
    return metrics.grid_metrics(point_view(spark, d), 20.0)


@query(metrics_sql("SELECT p.*, c.id FROM p JOIN centres c ON (p.x - c.x) * (p.x - c.x) + (p.y - c.y) * (p.y - c.y) <= 36.0", "id"), M)
def plot_metrics(spark, d):
    return metrics.plot_metrics(point_view(spark, d), centres(spark, d), 6.0)


@query(f"SELECT * EXCLUDE (k) FROM ({metrics_sql('SELECT *, 0 AS k FROM p', 'k')})", M)
def cloud_metrics(spark, d):
    return metrics.metrics(point_view(spark, d), [])


@query("SELECT CAST(floor(z / 0.5) AS BIGINT) AS bin, count(*) AS n FROM p GROUP BY 1")
def height_histogram(spark, d):
    return metrics.height_histogram(point_view(spark, d), 0.5)


@query("SELECT tree_id, max(h) FILTER (r = floor(0.98::DOUBLE * (n - 1) + 0.5) + 1) AS height, max(n) AS n_points FROM (SELECT tree_id, z AS h, row_number() OVER (PARTITION BY tree_id ORDER BY z) AS r, count(*) OVER (PARTITION BY tree_id) AS n FROM p) GROUP BY 1", "height")
def tree_heights(spark, d):
    return metrics.tree_heights(point_view(spark, d), 98.0)


@query("SELECT sum(pi() * (dbh / 2) * (dbh / 2)) / 10000.0::DOUBLE * 10000 AS basal_area, count(*) AS n_stems FROM (SELECT abs(value) / 10000.0::DOUBLE AS dbh FROM centres) WHERE dbh >= 0.1", "basal_area")
def basal_area(spark, d):
    return metrics.basal_area(centres(spark, d).withColumn("dbh", F.abs("value") / 10000.0), 10000.0, 0.1)


# --- neighbours -------------------------------------------------------------

D3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D2 = "(c.x - p.x) * (c.x - p.x) + (c.y - p.y) * (c.y - p.y)"
#: Pairs of points at most one apart, found in cells.
PAIRS = f"""SELECT a.pid, b.pid AS other, {D3} AS d2 FROM (SELECT *, floor(x) AS cx, floor(y) AS cy, floor(z) AS cz FROM p) a,
  (SELECT *, floor(x) + i AS cx, floor(y) + j AS cy, floor(z) + k AS cz FROM p, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) b
  WHERE a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND {D3} <= 1.0"""


@query(f"SELECT c.id, count(p.pid) AS n FROM centres c LEFT JOIN p ON {D2} <= 9.0 GROUP BY 1")
def count_within(spark, d):
    return neighbours.count_within(centres(spark, d), point_view(spark, d), 3.0, dims=2)


@query(f"SELECT pid, count(*) - 1 >= 4 AS keep FROM ({PAIRS}) GROUP BY 1")
def radius_outliers(spark, d):
    return neighbours.radius_outliers(point_view(spark, d), 1.0, 4).select("pid", "keep")


@query(f"SELECT id, pid, rank, sqrt(d2) AS distance FROM (SELECT c.id, p.pid, {D2} AS d2, row_number() OVER (PARTITION BY c.id ORDER BY {D2}, p.pid)::INT AS rank FROM centres c, p) WHERE rank <= 8", "distance")
def knn(spark, d):
    return neighbours.knn(centres(spark, d), point_view(spark, d), 8, 0.5, 200.0, dims=2).select("id", "pid", "rank", F.sqrt("d2").alias("distance"))


@query(f"SELECT id, pid, sqrt(d2) AS distance FROM (SELECT c.id, p.pid, {D2} AS d2, row_number() OVER (PARTITION BY c.id ORDER BY {D2}, p.pid) AS r FROM centres c, p) WHERE r = 1", "distance")
def nearest(spark, d):
    return neighbours.nearest(centres(spark, d), point_view(spark, d), 0.5, 200.0, dims=2).select("id", "pid", F.sqrt("d2").alias("distance"))


@query(
    f"""SELECT id, coalesce(avg(z) FILTER (d2 = 0), sum(z * pow(sqrt(d2), -2)) FILTER (d2 > 0) / sum(pow(sqrt(d2), -2)) FILTER (d2 > 0)) AS value FROM (
    SELECT c.id, p.z, {D2} AS d2, row_number() OVER (PARTITION BY c.id ORDER BY {D2}, p.pid) AS r FROM centres c, p) WHERE r <= 12 GROUP BY 1""",
    "value",
)
def inverse_distance(spark, d):
    return neighbours.inverse_distance(centres(spark, d).drop("value"), point_view(spark, d), "z", start=0.5, limit=200.0).select("id", "value")


@query(
    f"""SELECT id, arg_max(classification, (votes, -first)) AS label FROM (SELECT id, classification, count(*) AS votes, min(r) AS first FROM (
    SELECT c.id, p.classification, row_number() OVER (PARTITION BY c.id ORDER BY {D2}, p.pid) AS r FROM centres c, p) WHERE r <= 9 GROUP BY 1, 2) GROUP BY 1"""
)
def majority(spark, d):
    return neighbours.majority(centres(spark, d).drop("label"), point_view(spark, d), "classification", k=9, start=0.5, limit=200.0, dims=2).select("id", "label")


@query(f"SELECT pid FROM p WHERE EXISTS (SELECT 1 FROM centres c WHERE {D2} <= 4.0)")
def near_mask(spark, d):
    return neighbours.near_mask(point_view(spark, d), centres(spark, d), 2.0, dims=2).select("pid")


@query(
    f"""SELECT pid FROM p WHERE pid NOT IN (SELECT a.pid FROM (SELECT *, floor(x / 0.5) AS cx, floor(y / 0.5) AS cy, floor(z / 0.5) AS cz FROM p) a,
    (SELECT *, floor(x / 0.5) + i AS cx, floor(y / 0.5) + j AS cy, floor(z / 0.5) + k AS cz FROM later, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k)) b
    WHERE a.cx = b.cx AND a.cy = b.cy AND a.cz = b.cz AND {D3} <= 0.25)"""
)
def difference(spark, d):
    return neighbours.difference(point_view(spark, d), later_points(spark, d), 0.5).select("pid")


# --- pulses -----------------------------------------------------------------


@query("SELECT shot_id, zenith, azimuth, CAST(u.i AS INT) AS echo_rank, echoes[u.i].rank AS rank, echoes[u.i].pid AS pid, echoes[u.i].height AS height FROM shots, (SELECT unnest(generate_series(1, 1000)) AS i) u WHERE u.i <= len(echoes)", "zenith azimuth height")
def echo_rank(spark, d):
    return pulses.echoes(shots(spark, d))


@query("SELECT pid, pulse_no FROM (SELECT pid, dense_rank() OVER (PARTITION BY tree_id ORDER BY pulse) AS pulse_no FROM p)")
def pulses_from_returns(spark, d):
    return pulses.pulses_from_returns(point_view(spark, d), "tree_id", "pulse", ("return_number", "pid")).select("pid", "pulse_no")


@query(
    """SELECT event_id, user_id, sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
    SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) <= 36000 THEN 0 ELSE 1 END AS new FROM track)"""
)
def sessions(spark, d):
    return pulses.sessions(track(spark, d), "user_id", "t", 36000.0, ("event_id",)).select("event_id", "user_id", "session")


@query(
    """SELECT user_id, t AS "after", i, t + i * ((nxt - t) / n) AS t FROM (SELECT *, unnest(generate_series(1, n - 1)) AS i FROM (
    SELECT user_id, t, nxt, CAST(round((nxt - t) / 7200.0::DOUBLE) AS BIGINT) AS n FROM (SELECT user_id, t, lead(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS nxt FROM track)) WHERE n > 1 AND n - 1 <= 12)""",
    't',
)
def missing_pulses(spark, d):
    return pulses.missing_pulses(track(spark, d), "user_id", "t", 7200.0, 12, ("event_id",))


@query(
    """WITH f AS (SELECT * FROM track WHERE event_id % 2 = 0), q AS (SELECT * FROM track WHERE event_id % 2 = 1),
    a AS (SELECT q.event_id AS id, q.user_id, q.t, f.t AS ta, f.x AS xa, f.y AS ya, f.z AS za FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.t >= f.t),
    b AS (SELECT q.event_id AS id, f.t AS tb, f.x AS xb, f.y AS yb, f.z AS zb FROM q ASOF LEFT JOIN f ON q.user_id = f.user_id AND q.t <= f.t),
    j AS (SELECT *, CASE WHEN tb > ta THEN (t - ta) / (tb - ta) ELSE 0 END AS w, ta IS NOT NULL AND tb IS NOT NULL AND tb - ta <= 86400 AS ok FROM a JOIN b USING (id))
    SELECT id, user_id, t, CASE WHEN ok THEN xa + w * (xb - xa) END AS x, CASE WHEN ok THEN ya + w * (yb - ya) END AS y, CASE WHEN ok THEN za + w * (zb - za) END AS z FROM j""",
    "t x y z",
)
def interpolate_track(spark, d):
    t = track(spark, d)
    asked = t.filter("event_id % 2 = 1").select(F.col("event_id").alias("id"), "user_id", "t")
    return pulses.interpolate_track(asked, t.filter("event_id % 2 = 0"), "user_id", 86400.0)


GAPS = "SELECT CAST(floor(zenith / 5.0) AS BIGINT) AS ring, count(*) AS pulses, count(*) FILTER (len(list_filter(echoes, lambda e: e.height > 20.0)) = 0) AS gaps FROM shots WHERE zenith < 90 GROUP BY ALL"


def rings(spark, d, keys=()):
    return pulses.gap_fraction(shots(spark, d), 5.0, 90.0, 20.0, keys)


@query(f"SELECT *, gaps / pulses AS p FROM ({GAPS})", "p")
def gap_fraction(spark, d):
    return rings(spark, d)


@query(f"SELECT -ln(greatest(gaps / pulses, 1e-5)) * cos(radians(57.5)) / 0.5::DOUBLE AS pai FROM ({GAPS}) WHERE ring = 11", "pai")
def pai_hinge(spark, d):
    return pulses.pai_hinge(rings(spark, d))


@query(f"SELECT sum(-ln(greatest(gaps / pulses, 1e-5)) * (pow(sin(radians((ring + 1) * 5.0::DOUBLE)), 2) - pow(sin(radians(ring * 5.0::DOUBLE)), 2))) AS pai FROM ({GAPS})", "pai")
def pai_miller(spark, d):
    return pulses.pai_miller(rings(spark, d))


@query(
    f"""SELECT ring, ln(sum(p * pulses) / sum(pulses)) / (sum(ln(p) * pulses) / sum(pulses)) AS clumping, sum(pulses)::BIGINT AS pulses FROM (
    SELECT *, greatest(gaps / pulses, 1e-5) AS p FROM ({GAPS.replace("SELECT CAST", "SELECT CAST(floor(azimuth / 90.0) AS BIGINT) AS sector, CAST", 1)})) GROUP BY ring""",
    "clumping",
)
def clumping(spark, d):
    s = shots(spark, d).withColumn("sector", F.floor(F.col("azimuth") / 90.0))
    return pulses.clumping(pulses.gap_fraction(s, 5.0, 90.0, 20.0, ("sector",)))


@query(
    """WITH s AS (SELECT *, CAST(floor(zenith / 5.0) AS BIGINT) AS ring, CAST(floor(azimuth / 45.0) AS BIGINT) AS sector FROM shots)
    SELECT ring, sector, CAST(floor(h / 1.0) AS BIGINT) AS bin, sum(w) AS weight FROM (SELECT ring, sector, unnest(list_transform(echoes, lambda e: e.height)) AS h, 1.0::DOUBLE / len(echoes) AS w FROM s) GROUP BY ALL
    UNION ALL SELECT ring, sector, NULL, count(*)::DOUBLE FROM s GROUP BY ALL""",
    "weight",
)
def gap_histogram(spark, d):
    return pulses.gap_histogram(shots(spark, d))


@query(
    """WITH t AS (SELECT layer, count(*) AS hits FROM (SELECT CAST(max(floor(z / 1.0)) AS BIGINT) AS layer FROM p WHERE z > 1 GROUP BY floor(x / 0.5), floor(y / 0.5)) GROUP BY 1),
    a AS (SELECT layer, hits, (sum(hits) OVER () - coalesce(sum(hits) OVER (ORDER BY layer DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS alive FROM t)
    SELECT *, -ln(1 - least(hits / alive, 1 - 1e-6)) / 0.5::DOUBLE AS pad FROM a""",
    "pad",
)
def pad_profile(spark, d):
    return pulses.pad_profile(point_view(spark, d), 0.5, 1.0)


@query(
    """WITH w AS (SELECT *, 1.0::DOUBLE / count(*) OVER (PARTITION BY pulse) AS w FROM p),
    h AS (SELECT CAST(floor(y / 20.0) AS BIGINT) AS row, CAST(floor(x / 20.0) AS BIGINT) AS col, CAST(CASE WHEN z < 1 THEN 0 ELSE floor((z - 1) / 2.0) + 1 END AS BIGINT) AS layer, sum(w) AS w FROM w GROUP BY ALL),
    t AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY row, col ORDER BY layer ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(w) OVER (PARTITION BY row, col ORDER BY layer ROWS UNBOUNDED PRECEDING) AS reach, sum(w) OVER (PARTITION BY row, col) AS total FROM h)
    SELECT row, col, layer, w, -ln(greatest(below / reach, 0.5 / greatest(reach, 1))) / (0.5::DOUBLE * 2) AS pad, -ln(greatest(below / total, 0.5 / greatest(total, 1))) / 0.5::DOUBLE AS pai FROM t WHERE layer > 0""",
    "w pad pai",
)
def als_profile(spark, d):
    return pulses.als_profile(point_view(spark, d), 20.0, 2.0)


# --- change -----------------------------------------------------------------


@query(
    f"""WITH a AS ({CHM}), b AS ({RASTER.format(s="2.0", f="max(z)", t="later")}) SELECT row, col, a.value AS value_a, b.value AS value_b, b.value - a.value AS diff, abs(b.value - a.value) > 1.96 * sqrt(0.05::DOUBLE) AS significant FROM a JOIN b USING (row, col)""",
    "value_a value_b diff",
)
def raster_difference(spark, d):
    a, b = (raster.rasterize(f(spark, d), 2.0, reduce="max") for f in (point_view, later_points))
    return change.difference_of_rasters(a, b, 0.1, 0.2)


VOX = "SELECT CAST(floor(x / 2.0) AS BIGINT) AS ix, CAST(floor(y / 2.0) AS BIGINT) AS iy, CAST(floor(z / 2.0) AS BIGINT) AS iz, count(*) AS hits FROM {t} GROUP BY ALL"
BEAMS = "SELECT ix, iy, iz, 6 + (ix + iy + iz) % 5 AS beams FROM (SELECT unnest(generate_series(0, 49)) AS ix), (SELECT unnest(generate_series(0, 49)) AS iy), (SELECT unnest(generate_series(-1, 15)) AS iz)"


def beams(spark):
    i = spark.range(0, 50).select(F.col("id").alias("ix")).withColumn("iy", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))).withColumn("iz", F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(15).cast("long"))))
    return i.withColumn("beams", 6 + (F.col("ix") + F.col("iy") + F.col("iz")) % 5)


OCC = "SELECT ix, iy, iz, coalesce(hits, 0) AS h, greatest(coalesce(beams, 0), coalesce(hits, 0)) AS n FROM ({v}) FULL JOIN ({b}) USING (ix, iy, iz)"


@query(
    f"""WITH a AS ({OCC.format(v=VOX.format(t="p"), b=BEAMS)}), b AS ({OCC.format(v=VOX.format(t="later"), b=BEAMS)}),
    j AS (SELECT ix, iy, iz, coalesce(a.h, 0) AS ha, coalesce(a.n, 0) AS na, coalesce(b.h, 0) AS hb, coalesce(b.n, 0) AS nb FROM a FULL JOIN b USING (ix, iy, iz))
    SELECT *, CASE WHEN ha >= 1 AND hb >= 1 THEN 2 WHEN ha >= 1 AND hb = 0 AND nb >= 3 AND pow(1 - least(ha / na, 1), nb) <= 0.05 THEN 3
      WHEN hb >= 1 AND ha = 0 AND na >= 3 AND pow(1 - least(hb / nb, 1), na) <= 0.05 THEN 4 WHEN ha = 0 AND na >= 3 AND hb = 0 AND nb >= 3 THEN 1 ELSE 0 END AS class FROM j"""
)
def occupancy_change(spark, d):
    a, b = (change.occupancy(f(spark, d), beams(spark), 2.0) for f in (point_view, later_points))
    return change.occupancy_change(a, b)


@query(
    """WITH c AS (SELECT id, x, y, 15.0::DOUBLE AS z FROM centres),
    a AS (SELECT c.id, avg(q.z - c.z) AS m, stddev_samp(q.z - c.z) AS s, count(*) AS n FROM c JOIN p q ON (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) <= 4.0 AND abs(q.z - c.z) <= 5.0 GROUP BY 1),
    b AS (SELECT c.id, avg(q.z - c.z) AS m, stddev_samp(q.z - c.z) AS s, count(*) AS n FROM c JOIN later q ON (q.x - c.x) * (q.x - c.x) + (q.y - c.y) * (q.y - c.y) <= 4.0 AND abs(q.z - c.z) <= 5.0 GROUP BY 1),
    j AS (SELECT c.id, b.m - a.m AS distance, CASE WHEN coalesce(a.n, 0) >= 4 AND coalesce(b.n, 0) >= 4 THEN 1.96 * sqrt(a.s * a.s / a.n + b.s * b.s / b.n) END AS lod, coalesce(a.n, 0) AS na, coalesce(b.n, 0) AS nb FROM c LEFT JOIN a USING (id) LEFT JOIN b USING (id))
    SELECT *, coalesce(abs(distance) > lod, false) AS significant FROM j""",
    "distance lod",
)
def m3c2(spark, d):
    cores = centres(spark, d).select("id", "x", "y", F.lit(15.0).alias("z"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), F.lit(1.0).alias("nz"))
    return change.m3c2(cores, point_view(spark, d), later_points(spark, d), 2.0, 5.0)


@query(
    f"""WITH a AS ({CHM}), b AS ({RASTER.format(s="2.0", f="max(z)", t="later")}) SELECT CASE WHEN a.value <= 24 AND b.value <= 24 THEN 'persistent' WHEN a.value <= 24 THEN 'closed' WHEN b.value <= 24 THEN 'opened' ELSE 'canopy' END AS state,
    count(*) AS cells, avg(b.value - a.value) AS mean_change FROM a JOIN b USING (row, col) GROUP BY 1""",
    "mean_change",
)
def gap_change(spark, d):
    a, b = (raster.rasterize(f(spark, d), 2.0, reduce="max") for f in (point_view, later_points))
    return change.gap_change(a, b, 24.0)
