"""LAS point files: catalogue of headers, ranged reading, tiled writing.

Headers alone give the catalogue; points are read as ranges of records by many
tasks, so a file of any size costs a task no more than its range.  Compressed
(LAZ) files need a decoder that this environment lacks and are refused.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .files import filesystem, listed, read_at

# Fields of the point record formats of the LAS specification.
CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
OLD = [*CORE, ("bits", "u1"), ("class", "u1"), ("angle", "i1"), ("user_data", "u1"), ("point_source_id", "<u2")]
NEW = [*CORE, ("returns", "u1"), ("flags", "u1"), ("class", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("point_source_id", "<u2"), ("gps_time", "<f8")]
TIME, RGB = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
FORMATS = {0: OLD, 1: OLD + TIME, 2: OLD + RGB, 3: OLD + TIME + RGB, 6: NEW, 7: NEW + RGB}

POINT = T.StructType(
    [
        T.StructField("pid", T.LongType()),
        *[T.StructField(c, T.DoubleType()) for c in "xyz"],
        T.StructField("intensity", T.IntegerType()),
        T.StructField("return_number", T.ShortType()),
        T.StructField("number_of_returns", T.ShortType()),
        T.StructField("classification", T.ShortType()),
        T.StructField("scan_angle", T.DoubleType()),
        T.StructField("user_data", T.ShortType()),
        T.StructField("point_source_id", T.IntegerType()),
        T.StructField("gps_time", T.DoubleType()),
        T.StructField("red", T.IntegerType()),
        T.StructField("green", T.IntegerType()),
        T.StructField("blue", T.IntegerType()),
        T.StructField("file_no", T.IntegerType()),
    ]
)
CATALOG = "file_no int, path string, n_points long, point_format int, record_length int, data_at long, version string, sx double, sy double, sz double, ox double, oy double, oz double, xmin double, xmax double, ymin double, ymax double, zmin double, zmax double"


def header(data: bytes) -> dict:
    """What the public header block says."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    (data_at,) = struct.unpack("<I", data[96:100])
    fmt, length, count = struct.unpack("<BHI", data[104:111])
    if fmt & 0x80:
        raise ValueError("compressed points (LAZ) cannot be read here")
    scale, offset = struct.unpack("<3d", data[131:155]), struct.unpack("<3d", data[155:179])
    xmax, xmin, ymax, ymin, zmax, zmin = struct.unpack("<6d", data[179:227])
    if (major, minor) >= (1, 4) and len(data) >= 255:
        count = struct.unpack("<Q", data[247:255])[0] or count
    if fmt not in FORMATS:
        raise ValueError(f"point format {fmt} is not supported")
    s, o = (dict(zip("xyz", v, strict=True)) for v in (scale, offset))
    return {"n_points": count, "point_format": fmt, "record_length": length, "data_at": data_at, "version": f"{major}.{minor}", "sx": s["x"], "sy": s["y"], "sz": s["z"], "ox": o["x"], "oy": o["y"], "oz": o["z"], "xmin": xmin, "xmax": xmax, "ymin": ymin, "ymax": ymax, "zmin": zmin, "zmax": zmax}


def catalog(spark: SparkSession, uri: str) -> DataFrame:
    """A row for each LAS file under ``uri``, from headers alone."""
    files = [(i, p) for i, (p, _) in enumerate(listed(uri, (".las",)))]
    names = [c.split()[0] for c in CATALOG.split(", ")]

    def run(batches):
        for b in batches:
            rows = [{"file_no": i, "path": p, **header(read_at(p, 0, 375))} for i, p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows], schema=to_arrow())

    def to_arrow():
        kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
        return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in CATALOG.split(", ")])

    listing = spark.createDataFrame(files, "file_no int, path string")
    return listing.repartition(max(1, min(len(files), 1000))).mapInArrow(run, CATALOG)


def issues(tiles: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Pairs of files whose boxes overlap by more than ``tolerance``, and mixed point formats."""
    a = tiles.select("file_no", "xmin", "xmax", "ymin", "ymax", "point_format")
    size = a.agg(F.max(F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")))).first()[0] or 1.0
    size = max(size, 1e-6)

    def spread(t: DataFrame) -> DataFrame:
        t = t.withColumn("cx", F.explode(F.sequence(F.floor(F.col("xmin") / size), F.floor(F.col("xmax") / size))))
        return t.withColumn("cy", F.explode(F.sequence(F.floor(F.col("ymin") / size), F.floor(F.col("ymax") / size))))

    b = spread(a).select("cx", "cy", *[F.col(c).alias(f"{c}2") for c in a.columns])
    both = spread(a).join(b, ["cx", "cy"]).filter("file_no < file_no2")
    wide = F.least("xmax", "xmax2") - F.greatest("xmin", "xmin2")
    high = F.least("ymax", "ymax2") - F.greatest("ymin", "ymin2")
    over = both.filter((wide > tolerance) & (high > tolerance)).select(F.lit("overlap").alias("kind"), "file_no", F.col("file_no2").alias("other")).distinct()
    formats = both.filter("point_format <> point_format2").select(F.lit("format").alias("kind"), "file_no", F.col("file_no2").alias("other")).distinct()
    return over.union(formats)


def read(spark: SparkSession, uri: str, bounds: tuple[float, float, float, float] | None = None, records: int = 500_000) -> DataFrame:
    """Points of all LAS files under ``uri``; files outside ``bounds`` are not opened.

    ``pid`` is the file's number in the high bits and the record's in the low 40.
    """
    tiles = catalog(spark, uri)
    if bounds:
        x0, y0, x1, y1 = bounds
        tiles = tiles.filter((F.col("xmax") >= x0) & (F.col("xmin") <= x1) & (F.col("ymax") >= y0) & (F.col("ymin") <= y1))
    ranges = tiles.filter("n_points > 0").withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_points") - 1, F.lit(records).cast("long"))))
    fields = ["file_no", "path", "n_points", "point_format", "record_length", "data_at", "sx", "sy", "sz", "ox", "oy", "oz", "first"]

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n = min(records, r["n_points"] - r["first"])
                dtype = np.dtype({"names": [f for f, _ in FORMATS[r["point_format"]]], "formats": [t for _, t in FORMATS[r["point_format"]]], "offsets": offsets(r["point_format"]), "itemsize": r["record_length"]})
                p = np.frombuffer(read_at(r["path"], r["data_at"] + r["first"] * r["record_length"], n * r["record_length"]), dtype)
                yield points(p, r)

    out = ranges.select(*fields).repartition(F.col("path"), F.col("first")).mapInArrow(run, POINT)
    if bounds:
        x0, y0, x1, y1 = bounds
        out = out.filter(F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
    return out


def offsets(fmt: int) -> list[int]:
    sizes = [np.dtype(t).itemsize for _, t in FORMATS[fmt]]
    return [sum(sizes[:i]) for i in range(len(sizes))]


def points(p: np.ndarray, r: dict) -> pa.RecordBatch:
    n = len(p)
    new = r["point_format"] >= 6
    none = lambda t: pa.nulls(n, t)
    has = p.dtype.names
    cols = [
        pa.array((np.int64(r["file_no"]) << 40) + r["first"] + np.arange(n)),
        *[pa.array(p[c.upper()] * r[f"s{c}"] + r[f"o{c}"]) for c in "xyz"],
        pa.array(p["intensity"].astype("i4")),
        pa.array((p["returns"] & 15 if new else p["bits"] & 7).astype("i2")),
        pa.array((p["returns"] >> 4 if new else p["bits"] >> 3 & 7).astype("i2")),
        pa.array((p["class"] if new else p["class"] & 31).astype("i2")),
        pa.array(p["angle"] * (0.006 if new else 1.0)),
        pa.array(p["user_data"].astype("i2")),
        pa.array(p["point_source_id"].astype("i4")),
        pa.array(p["gps_time"]) if "gps_time" in has else none(pa.float64()),
        *[pa.array(p[c].astype("i4")) if c in has else none(pa.int32()) for c in ("red", "green", "blue")],
        pa.array(np.full(n, r["file_no"], "i4")),
    ]
    return pa.RecordBatch.from_arrays(cols, names=[f.name for f in POINT])


def encode(t: pa.Table, scale: float) -> bytes:
    """A LAS 1.4 file of point format 6."""
    xyz = np.stack([t.column(c).to_numpy() for c in "xyz"], 1).astype(float)
    n = len(xyz)
    low, high = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    offset = np.floor(low)
    p = np.zeros(n, np.dtype(FORMATS[6]))
    for i, c in enumerate("XYZ"):
        p[c] = np.rint((xyz[:, i] - offset[i]) / scale)

    def take(name: str, default: float = 0):
        return np.nan_to_num(t.column(name).to_numpy(zero_copy_only=False).astype(float), nan=default) if name in t.column_names else np.full(n, float(default))

    p["intensity"] = take("intensity")
    p["returns"] = take("return_number", 1).astype("u1") | (take("number_of_returns", 1).astype("u1") << 4)
    p["class"] = take("classification")
    p["user_data"] = take("user_data")
    p["angle"] = np.rint(take("scan_angle") / 0.006)
    p["point_source_id"] = take("point_source_id")
    p["gps_time"] = take("gps_time")
    h = bytearray(375)
    h[:4] = b"LASF"
    h[24:26] = bytes([1, 4])
    struct.pack_into("<HIIBHI", h, 94, 375, 375, 0, 6, 30, n if n < 1 << 32 else 0)
    struct.pack_into("<3d3d", h, 131, *[scale] * 3, *offset)
    struct.pack_into("<6d", h, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    struct.pack_into("<Q", h, 247, n)
    return bytes(h) + p.tobytes()


def write_tiles(tiles: DataFrame, uri: str, scale: float = 0.001, most: int = 5_000_000) -> DataFrame:
    """Write ``tiles`` (points with ``tx, ty``) as LAS files; returns ``tx, ty, path, n_points``.

    A tile with more than ``most`` points is divided into several files by a
    hash of the points, so no task holds more whatever a tile's density is.
    """
    counts = tiles.groupBy("tx", "ty").agg(F.ceil(F.count("*") / most).cast("int").alias("files"))
    held = tiles.join(counts, ["tx", "ty"]).withColumn("file", F.pmod(F.xxhash64("pid"), F.col("files")).cast("int")).drop("files")
    schema = "tx long, ty long, path string, n_points long"

    def run(pdf):
        import pandas as pd

        fs, root = filesystem(uri)
        fs.create_dir(root, recursive=True)
        pdf = pdf.sort_values("pid")
        tx, ty = int(pdf["tx"].iloc[0]), int(pdf["ty"].iloc[0])
        path = f"{root}/tile_{tx}_{ty}_{int(pdf['file'].iloc[0])}.las"
        part = f"{path}.{uuid.uuid4().hex[:8]}.part"
        with fs.open_output_stream(part) as f:
            f.write(encode(pa.Table.from_pandas(pdf, preserve_index=False), scale))
        fs.move(part, path)  # a repeated task puts the same file in its place
        return pd.DataFrame({"tx": [tx], "ty": [ty], "path": [path], "n_points": [len(pdf)]})

    return held.groupBy("tx", "ty", "file").applyInPandas(run, schema)
