from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators.points import tiled
from pulsegrid.operators.polygons import polygon_join
from pulsegrid.sources import las, text
from pulsegrid.streaming import aggregates

DATA = "/root/testdata/sf0.001"


def test_las_tiles_round_trip(spark, tmp_path):
    r = np.random.default_rng(1)
    n = 2000
    df = pd.DataFrame({"pid": np.arange(n), "x": r.uniform(500000, 500100, n), "y": r.uniform(100, 200, n), "z": r.uniform(0, 30, n), "intensity": r.integers(0, 60000, n), "classification": r.integers(1, 8, n), "return_number": r.integers(1, 6, n), "gps_time": r.uniform(0, 1e6, n)})
    written = las.write_tiles(tiled(spark.createDataFrame(df), 50.0), str(tmp_path / "t"), most=300)
    assert written.agg(F.sum("n_points")).first()[0] == n
    cat = las.catalog(spark, str(tmp_path / "t"))
    assert cat.count() > 4 and cat.agg(F.sum("n_points")).first()[0] == n
    got = las.read(spark, str(tmp_path / "t"), records=100).toPandas()
    assert got["pid"].is_unique and len(got) == n
    a, b = (f.sort_values("gps_time").reset_index(drop=True) for f in (df, got))
    assert np.abs(a[["x", "y", "z"]].to_numpy() - b[["x", "y", "z"]].to_numpy()).max() <= 0.00051
    for c in ("intensity", "classification", "return_number"):
        assert (a[c] == b[c]).all()
    part = las.read(spark, str(tmp_path / "t"), bounds=(500000, 100, 500020, 150)).count()
    assert part == ((df.x <= 500020) & (df.y <= 150)).sum()
    assert las.issues(cat.limit(0)).count() == 0
    assert las.issues(cat).filter("kind = 'overlap'").count() > 0  # several files of a tile


def test_las_refuses_what_it_cannot_read():
    with pytest.raises(ValueError, match="not a LAS"):
        las.header(b"x" * 400)
    h = bytearray(las.encode(__import__("pyarrow").table({"x": [1.0], "y": [2.0], "z": [3.0]}), 0.01))
    h[104] |= 0x80
    with pytest.raises(ValueError, match="LAZ"):
        las.header(bytes(h))


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.xyz").write_text("# comment\n1 2 3\n4,5;6 7\n\n// x\n7 8 nan\n")
    got = sorted((r.x, r.y) for r in text.read_xyz(spark, str(tmp_path / "a.xyz")).collect())
    assert got == [(1.0, 2.0), (4.0, 5.0), (7.0, 8.0)]
    p = pd.DataFrame({"x": [1.5, 2.5], "y": [0.0, -1.0], "z": [9.0, 8.0]})
    text.write_ply(p, str(tmp_path / "p.ply"))
    (tmp_path / "q.ply").write_text("ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nproperty float y\nproperty uchar c\nproperty float z\nend_header\n1 2 3 4\n")
    got = sorted(tuple(r) for r in text.read_ply(spark, str(tmp_path / "*.ply")).collect())
    assert got == [(1.0, 2.0, 4.0), (1.5, 0.0, 9.0), (2.5, -1.0, 8.0)]
    r = spark.createDataFrame([(i, j, i + j / 10) for i in range(7) for j in range(5) if (i, j) != (3, 3)], "row long, col long, value double")
    assert text.write_ascii_grid(r, str(tmp_path / "grids"), 2.0, (100.0, 50.0), most=16) == 4
    back = text.read_ascii_grid(spark, str(tmp_path / "grids"))
    moved = back.select(((F.col("ymin") - 50) / 2 + F.col("row")).cast("long").alias("row"), ((F.col("xmin") - 100) / 2 + F.col("col")).cast("long").alias("col"), "value")
    assert sorted(map(tuple, moved.collect())) == sorted(map(tuple, r.collect()))
    rec = np.zeros((2, 17))
    rec[:, 0] = [1.0, 2.0]
    rec[:, 1] = np.pi / 4
    (tmp_path / "s.sbet").write_bytes(text.pack_sbet(rec))
    got = text.read_sbet(spark, str(tmp_path / "s.sbet")).collect()
    assert [g.t for g in got] == [1.0, 2.0] and got[0].latitude == pytest.approx(45)


def test_polygons_from_geojson(spark, tmp_path):
    square = [[[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]]
    features = [{"type": "Feature", "properties": {"name": "a", "n": 1}, "geometry": {"type": "Polygon", "coordinates": square}}, {"type": "Feature", "properties": None, "geometry": {"type": "MultiPolygon", "coordinates": [[[[10, 10], [12, 10], [11, 13]]]]}}]
    (tmp_path / "f.json").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    polys = text.read_polygons(spark, str(tmp_path / "f.json"))
    assert polys.filter("attributes['name'] = 'a'").count() == 1
    pts = spark.createDataFrame([(1, 0.5, 0.5), (2, 1.5, 1.5), (3, 4.0, 2.0), (4, 11.0, 11.0), (5, 5.0, 5.0), (6, 1.0, 1.5)], "pid long, x double, y double")
    assert sorted((r.pid, r.feature) for r in polygon_join(pts, polys, 3.0).collect()) == [(1, 0), (3, 0), (4, 1), (6, 0)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_streams_equal_batches(spark, tmp_path):
    src = tmp_path / "in"
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    out = aggregates.run_to_table(aggregates.windowed(stream, "1 day", None, "40 days"), "by_day", str(tmp_path / "c1"))
    key = lambda d: sorted((r.start, r.event_type, r.n, round(r.total, 6)) for r in d.collect())
    assert key(out) == key(aggregates.windowed(events, "1 day", None, "1 day"))
    pts = events.select(F.col("event_id").alias("pid"), (F.col("event_id") % 100).cast("double").alias("x"), (F.col("event_id") % 77).cast("double").alias("y"), F.col("value").alias("z"))
    pts.repartition(2).write.parquet(str(tmp_path / "p"))
    s = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "p"))
    out = aggregates.run_to_table(aggregates.grid(s, 10.0), "cells", str(tmp_path / "c2"))
    key = lambda d: sorted((r.row, r.col, r.n, round(r["sum"], 6), r.low, r.high) for r in d.collect())
    assert key(out) == key(aggregates.grid(pts, 10.0))
