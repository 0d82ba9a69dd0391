"""Point, pulse and trajectory views of the relational test tables.

The arithmetic is the same in Spark and in the SQL counterparts, so results can
be compared row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTS_SQL = """
SELECT (l_orderkey * 8 + l_linenumber) * 1073741824 + (l_partkey * 1009 + l_suppkey) % 1073741824 AS pid,
  CAST((l_orderkey * 7919 + l_linenumber * 613) % 10000 AS DOUBLE) / 100.0 AS x,
  CAST((l_partkey * 3571 + l_suppkey * 101 + l_linenumber * 31) % 10000 AS DOUBLE) / 100.0 AS y,
  CAST(CAST(floor(l_extendedprice) AS BIGINT) % 3000 AS DOUBLE) / 100.0 AS z,
  CAST(l_quantity AS INT) * 100 AS intensity, l_linenumber AS return_number,
  CASE WHEN CAST(floor(l_extendedprice) AS BIGINT) % 3000 < 150 THEN 2 WHEN l_returnflag = 'R' THEN 7 ELSE 1 END AS classification,
  l_orderkey AS pulse, l_suppkey AS tree_id
FROM lineitem
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pid, x, y, z, intensity, return_number, classification, pulse, tree_id``."""
    t = table(spark, sf_dir, "lineitem")
    price = F.floor("l_extendedprice") % 3000
    c = F.col
    return t.select(
        ((c("l_orderkey") * 8 + c("l_linenumber")) * 1073741824 + (c("l_partkey") * 1009 + c("l_suppkey")) % 1073741824).alias("pid"),
        (((c("l_orderkey") * 7919 + c("l_linenumber") * 613) % 10000).cast("double") / 100.0).alias("x"),
        (((c("l_partkey") * 3571 + c("l_suppkey") * 101 + c("l_linenumber") * 31) % 10000).cast("double") / 100.0).alias("y"),
        (price.cast("double") / 100.0).alias("z"),
        (c("l_quantity").cast("int") * 100).alias("intensity"),
        c("l_linenumber").alias("return_number"),
        F.when(price < 150, 2).when(c("l_returnflag") == "R", 7).otherwise(1).alias("classification"),
        c("l_orderkey").alias("pulse"),
        c("l_suppkey").alias("tree_id"),
    )


def later_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second epoch: most points again, raised or lowered by up to 0.3."""
    p = points(spark, sf_dir).filter("pid % 11 <> 0")
    return p.withColumn("z", F.col("z") + ((F.col("pid") % 7) - 3).cast("double") / 10.0)


LATER_SQL = f"SELECT * REPLACE (z + CAST((pid % 7) - 3 AS DOUBLE) / 10.0 AS z) FROM ({POINTS_SQL}) WHERE pid % 11 <> 0"

CENTRES_SQL = """
SELECT s_suppkey AS id, CAST((s_suppkey * 7919) % 10000 AS DOUBLE) / 100.0 AS x, CAST((s_suppkey * 3571) % 10000 AS DOUBLE) / 100.0 AS y, s_acctbal AS value,
  CAST(s_nationkey AS BIGINT) AS label FROM supplier
"""


def centres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, x, y, value, label``: suppliers as stem or plot centres."""
    c = F.col
    return table(spark, sf_dir, "supplier").select(
        c("s_suppkey").alias("id"),
        (((c("s_suppkey") * 7919) % 10000).cast("double") / 100.0).alias("x"),
        (((c("s_suppkey") * 3571) % 10000).cast("double") / 100.0).alias("y"),
        c("s_acctbal").alias("value"),
        c("s_nationkey").cast("long").alias("label"),
    )


SHOTS_SQL = f"""
SELECT o_orderkey AS shot_id, CAST(o_custkey % 100 AS DOUBLE) AS ox, CAST(o_custkey % 97 AS DOUBLE) AS oy, 40.0::DOUBLE AS oz,
  CAST(o_orderkey % 8900 AS DOUBLE) / 100.0 AS zenith, CAST(o_orderkey % 36000 AS DOUBLE) / 100.0 AS azimuth,
  coalesce(e.echoes, []) AS echoes
FROM orders LEFT JOIN (
  SELECT pulse, list({{'rank': return_number, 'height': z, 'pid': pid}} ORDER BY return_number, pid) AS echoes FROM ({POINTS_SQL}) GROUP BY pulse) e ON pulse = o_orderkey
"""


def shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pulses: origin, angles in degrees, echoes in order; none is a miss."""
    c = F.col
    echo = F.struct(c("return_number").alias("rank"), "pid", c("z").alias("height"))
    held = points(spark, sf_dir).groupBy("pulse").agg(F.sort_array(F.collect_list(echo)).alias("echoes"))
    o = table(spark, sf_dir, "orders").select(
        c("o_orderkey").alias("shot_id"),
        (c("o_custkey") % 100).cast("double").alias("ox"),
        (c("o_custkey") % 97).cast("double").alias("oy"),
        F.lit(40.0).alias("oz"),
        ((c("o_orderkey") % 8900).cast("double") / 100.0).alias("zenith"),
        ((c("o_orderkey") % 36000).cast("double") / 100.0).alias("azimuth"),
    )
    out = o.join(held, o["shot_id"] == held["pulse"], "left").drop("pulse")
    return out.withColumn("echoes", F.coalesce("echoes", F.array().cast(held.schema["echoes"].dataType)))


TRACK_SQL = """
SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, CAST(event_id % 1000 AS DOUBLE) AS x, CAST(event_id % 777 AS DOUBLE) AS y, value AS z, event_type FROM events
"""


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trajectory of each user: ``user_id, event_id, t, x, y, z, event_type``."""
    c = F.col
    return table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))") / 1e6).alias("t"),
        (c("event_id") % 1000).cast("double").alias("x"),
        (c("event_id") % 777).cast("double").alias("y"),
        c("value").alias("z"),
        "event_type",
    )
