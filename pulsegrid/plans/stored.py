"""Queries over files that Spark writes from the given tables and reads again through its data sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import las_source, waveforms
from .catalog import query
from .scratch import shared_dir
from .views import points as point_view
from .views import table


def folder(spark, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@query("SELECT x, y, z, intensity, CAST(return_number AS SMALLINT) AS return_number, CAST(classification AS SMALLINT) AS classification FROM p WHERE z >= 12.5 AND x < 60 AND classification IN (1, 2)", "x y z")
def las_pushdown(spark, d):
    """Points written as LAS files and read by columns, with filters evaluated in the source."""
    las_source.register(spark)
    uri = folder(spark, "las")
    point_view(spark, d).select("x", "y", "z", "intensity", "return_number", "classification").write.format("las").mode("append").option("scale", 0.01).save(uri)
    columns = "x double, y double, z double, intensity int, return_number smallint, classification smallint"
    return spark.read.format("las").schema(columns).load(uri).filter("z >= 12.5D and x < 60D and classification in (1, 2)")


WAVES = """SELECT CAST(o_orderkey AS DOUBLE) AS gps_time, CAST(o_custkey % 100 AS DOUBLE) AS x, CAST(o_custkey % 97 AS DOUBLE) AS y, 40.0::DOUBLE AS z, w.returns, 2000.0::DOUBLE AS location_ps, w.samples
    FROM orders JOIN (SELECT l_orderkey, CAST(1 + count(*) % 3 AS INT) AS returns, list(CAST(l_quantity AS FLOAT) ORDER BY l_linenumber, l_quantity) AS samples FROM lineitem GROUP BY 1) w ON o_orderkey = l_orderkey"""


def pulses(spark, d) -> DataFrame:
    """Orders as digitised pulses; their lines' quantities are the samples."""
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("float").alias("v")))).getField("v")
    held = table(spark, d, "lineitem").groupBy("l_orderkey").agg((1 + F.count("*") % 3).cast("int").alias("returns"), each.alias("samples"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 100).cast("double").alias("x"), (F.col("o_custkey") % 97).cast("double").alias("y"))
    fixed = {"z": 40.0, "location_ps": 2000.0, "vx": 0.0, "vy": 0.0, "vz": 0.00015}
    out = o.join(held, "l_orderkey").withColumns({k: F.lit(v) for k, v in fixed.items()})
    return out.select(F.col("l_orderkey").cast("double").alias("gps_time"), "x", "y", "z", "returns", "location_ps", "vx", "vy", "vz", F.lit(1000).cast("long").alias("interval_ps"), "samples")


def written(spark, d) -> str:
    waveforms.register(spark)
    uri = folder(spark, "waves")
    pulses(spark, d).write.format("las_waveforms").mode("append").save(uri)
    return uri


@query(f"SELECT gps_time, x, y, z, returns, location_ps, array_to_string(samples, ' ') AS samples FROM ({WAVES})", "gps_time x y z location_ps")
def waveform_packets(spark, d):
    """Pulses written with their packets and read in ranges of records."""
    found = spark.read.format("las_waveforms").option("records", 20_000).load(written(spark, d))
    text = F.concat_ws(" ", F.transform("samples", lambda v: v.cast("string")))
    return found.select("gps_time", "x", "y", "z", "returns", "location_ps", text.alias("samples"))


@query(f"SELECT x, y, count(*) AS pulses, sum(len(samples)) AS samples, sum(list_sum(samples)) AS energy FROM ({WAVES}) GROUP BY 1, 2", "energy")
def stream_waveforms(spark, d):
    """The same files as a stream, summed by place."""
    uri = written(spark, d)
    out = folder(spark, "waves-out")
    stream = spark.readStream.format("las_waveforms").option("records", 20_000).load(uri)
    each = stream.select("x", "y", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, v: a + v).alias("e"))
    run = each.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(each.schema).parquet(f"{out}/data").groupBy("x", "y").agg(F.count("*").alias("pulses"), F.sum("n").alias("samples"), F.sum("e").alias("energy"))
