from __future__ import annotations

import contextlib
import io
import os

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulsegrid.sources import las, las_source, waveforms


@pytest.fixture(scope="module")
def cloud():
    r = np.random.default_rng(7)
    n = 3000
    x = np.sort(r.uniform(0, 300, n)).round(2)  # files become strips
    return pd.DataFrame({"x": x, "y": r.uniform(0, 50, n).round(2), "z": r.uniform(0, 40, n).round(2), "intensity": r.integers(0, 60000, n).astype("i4"), "classification": r.integers(1, 8, n).astype("i2"), "gps_time": r.uniform(0, 9, n)})


@pytest.fixture(scope="module")
def stored(spark, cloud, tmp_path_factory):
    las_source.register(spark)
    uri = str(tmp_path_factory.mktemp("las") / "t")
    spark.createDataFrame(cloud).coalesce(1).write.format("las").mode("append").option("scale", 0.01).option("pointsPerFile", 500).save(uri)
    assert len([f for f in os.listdir(uri) if f.endswith(".las")]) == 6 and not [f for f in os.listdir(uri) if f.startswith("_")]
    return uri


def rows(df, names):
    return sorted(tuple(round(float(v), 3) for v in r) for r in df.select(*names).toPandas().itertuples(index=False))


CONDITIONS = [
    "z > 20", "x < 120.5 and z >= 3", "classification = 5", "classification in (2, 6) and y <= 25", "intensity > 1000 and not (z < 5)",
    "z > 39 or x > 250", "x is not null and z = 12.34", "red is not null", "red > 5", "gps_time > 4.5", "x in (1.0, 2.0)", "pid % 2 = 0 and x > 100",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_filters_in_the_source_keep_what_spark_keeps(spark, stored, condition):
    names = ["x", "y", "z", "intensity", "classification", "gps_time"]
    whole = las.read(spark, stored)  # decodes whole records, filters nothing
    got = spark.read.format("las").option("rangeBytes", 4000).load(stored).filter(condition)
    assert rows(got, names) == rows(whole.filter(condition), names)


def test_filters_are_pushed_and_read_little(spark, stored, monkeypatch):
    df = spark.read.format("las").schema("x double, z double").load(stored).filter("x > 290 and z < 20")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        df.explain("formatted")
    plan = shown.getvalue()
    assert "GreaterThan(x,290.0)" in plan and "LessThan(z,20.0)" in plan and "ReadSchema: struct<x:double,z:double>" in plan
    assert "Filter (" not in plan  # nothing is left for Spark
    read, decoded = [], []
    real, column = las_source.read_at, las_source.Records.column
    monkeypatch.setattr(las_source, "read_at", lambda p, a, n: read.append(n) or real(p, a, n))
    monkeypatch.setattr(las_source.Records, "column", lambda self, name: decoded.append(name) or column(self, name))
    from pyspark.sql import types as T

    def scan(filters):
        read.clear()
        decoded.clear()
        reader = las_source.LasReader({"path": stored}, T.StructType([f for f in las.POINT if f.name in ("x", "z")]))
        left = list(reader.pushFilters(filters))
        out = [b for p in reader.partitions() for b in reader.read(p)]
        return left, sum(b.num_rows for b in out), sum(read)

    left, n, size = scan([])
    assert n == 3000 and size == 6 * las_source.HEADER + 3000 * 30 and set(decoded) == {"x", "z"}
    left, n, size = scan([las_source.GreaterThan(("x",), 290.0), las_source.EqualTo(("classification",), 3)])
    assert not left and size == 6 * las_source.HEADER + 500 * 30  # five files are ruled out by their headers
    assert n == df.sparkSession.read.format("las").load(stored).filter("x > 290 and classification = 3").count()


def test_ranges_split_a_file_without_loss(spark, stored, cloud):
    for size in (1000, 377, 90_000):
        got = spark.read.format("las").option("rangeBytes", size).load(stored)
        assert got.count() == 3000 and got.select("pid").distinct().count() == 3000
    with pytest.raises(Exception, match="is not one of"):
        spark.read.format("las").schema("x float").load(stored).collect()


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    las_source.register(spark)
    bad = spark.range(10).select(F.when(F.col("id") < 9, 1.0).otherwise(F.raise_error("no").cast("double")).alias("x"), F.lit(1.0).alias("y"), F.lit(1.0).alias("z"))
    with pytest.raises(Exception, match="no"):
        bad.coalesce(1).write.format("las").mode("append").save(str(tmp_path / "t"))
    assert not [f for f in os.listdir(tmp_path) if f.endswith(".las")]


def pulses(n, seed, start=0):
    r = np.random.default_rng(seed)
    out = []
    for i in range(n):
        k = int(r.integers(1, 6)) * 8
        s = r.integers(0, 300, k).astype(float) if i % 3 else r.normal(0, 1, k)
        out.append((float(start + i), float(i % 10), float(i % 7), 5.0, int(r.integers(1, 6)), 1000.0, 0.0, 0.0, 0.00015, 1000, s.tolist()))
    return out


PULSE = "gps_time double, x double, y double, z double, returns int, location_ps double, vx double, vy double, vz double, interval_ps long, samples array<double>"


def put(spark, uri, made):
    spark.createDataFrame(made, PULSE).coalesce(1).write.format("las_waveforms").mode("append").save(uri)


def same(got, made):
    got = sorted(got, key=lambda r: r.gps_time)
    assert [(r.gps_time, r.x, r.y, r.returns, r.interval_ps) for r in got] == [(p[0], p[1], p[2], p[4], p[9]) for p in made]
    for r, p in zip(got, made, strict=True):
        assert len(r.samples) == len(p[10]) and np.abs(np.array(r.samples) - p[10]).max() < 1e-3


@pytest.mark.parametrize("records", [1, 2, 7, 100_000])
def test_waveforms_in_ranges_are_whole_and_once(spark, tmp_path, records):
    waveforms.register(spark)
    made = pulses(60, 1)
    put(spark, str(tmp_path / "w"), made)
    same(spark.read.format("las_waveforms").option("records", records).load(str(tmp_path / "w")).collect(), made)


def test_packets_beside_the_file(spark, tmp_path):
    waveforms.register(spark)
    made = pulses(9, 2)
    table = pa.Table.from_pandas(pd.DataFrame(made, columns=[c.split()[0] for c in PULSE.split(", ")]))
    raw = bytearray(waveforms.encode(table, 0.001))
    at = int.from_bytes(raw[227:235], "little")
    (tmp_path / "a.wdp").write_bytes(raw[at:])
    raw = raw[:at]
    raw[6:8] = (4).to_bytes(2, "little")
    (tmp_path / "a.las").write_bytes(raw)
    same(spark.read.format("las_waveforms").load(str(tmp_path)).collect(), made)
    for bad in (b"x" * 400, bytes(raw[:104]) + b"\x89" + bytes(raw[105:]), bytes(raw[:104]) + b"\x06" + bytes(raw[105:])):
        (tmp_path / "b.las").write_bytes(bad)
        with pytest.raises(ValueError):
            waveforms.header(str(tmp_path / "b.las"))


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    waveforms.register(spark)
    uri, out = str(tmp_path / "in"), str(tmp_path / "out")

    def step():
        stream = spark.readStream.format("las_waveforms").option("records", 13).load(uri)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(waveforms.WAVEFORM).parquet(out).collect()

    made = pulses(50, 3)
    put(spark, uri, made)
    same(step(), made)
    same(step(), made)  # nothing new: nothing is repeated
    for k in range(2):  # each time a new query from the checkpoint
        more = pulses(20, 4 + k, 50 + 20 * k)
        put(spark, uri, more)
        made += more
        same(step(), made)
    same(spark.read.format("las_waveforms").load(uri).collect(), made)


def test_sample_places_and_noise(spark):
    r = np.random.default_rng(5)
    s = (50 + r.normal(0, 2, 400)).tolist()
    s[100:110] = [500.0] * 10
    made = [("a", 0, 1, 0.0, 1.0, 2.0, 3.0, 2000.0, 0.0, 0.0, 0.001, 1000, s), ("a", 1, 1, 0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.001, 1000, []), ("a", 2, 1, 0.0, 1.0, 2.0, 3.0, 0.0, 0.0, 0.0, 0.001, 1000, [4.0] * 5)]
    df = spark.createDataFrame(made, waveforms.WAVEFORM)
    got = {x.record: (x.background, x.noise) for x in waveforms.noise(df).collect()}
    assert abs(got[0][0] - 50) < 0.4 and abs(got[0][1] - 2) < 0.2 and got[1] == (None, None) and got[2] == (4.0, 0.0)
    z = {x.i: x.z for x in waveforms.sample_points(df).filter("record = 0 and i < 3").collect()}
    assert z == {0: 5.0, 1: 4.0, 2: 3.0}
