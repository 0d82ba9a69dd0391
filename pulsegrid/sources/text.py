"""Text and small binary formats: point text, PLY, ASCII grids, polygons, trajectories."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import filesystem

POINT_TEXT = "pid long, x double, y double, z double"


def read_xyz(spark: SparkSession, path: str, names: tuple[str, ...] = ("x", "y", "z"), header: bool = False) -> DataFrame:
    """Columns of numbers parted by blanks, commas or semicolons; ``#`` and ``//`` begin comments.

    Lines are split by Spark's text reader, so files of any size are shared out.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("path"))
    lines = lines.filter((F.col("v") != "") & ~F.col("v").rlike(r"^(#|//)"))
    parts = F.split("v", r"[\s,;]+")
    rows = lines.select(*[F.try_element_at(parts, F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(names)])
    return rows.filter(F.col("x").isNotNull()) if header else rows


def write_xyz(points: DataFrame, path: str, names: tuple[str, ...] = ("x", "y", "z")) -> None:
    points.select(F.concat_ws(" ", *[F.col(n).cast("string") for n in names])).write.text(path)


# The scalar types of the PLY format.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def parse_ply(data: bytes) -> pd.DataFrame:
    """Vertices of a PLY file, text or binary; lists of other elements are passed over."""
    head, mark, body = data.partition(b"end_header")
    if not data.startswith(b"ply") or not mark:
        raise ValueError("not a PLY file")
    body = body[body.index(b"\n") + 1 :]
    kind, fields, n, element = "ascii", [], 0, ""
    for line in head.decode("ascii", "replace").splitlines():
        w = line.split()
        if not w:
            continue
        if w[0] == "format":
            kind = w[1]
        elif w[0] == "element":
            element = w[1]
            if element == "vertex":
                n = int(w[2])
            elif not fields:
                raise ValueError("vertices must come first")
        elif w[0] == "property" and element == "vertex":
            if w[1] == "list":
                raise ValueError("lists in vertices are not supported")
            fields.append((w[2], PLY_TYPES[w[1]]))
    if kind == "ascii":
        table = np.array([line.split()[: len(fields)] for line in body.decode("ascii").splitlines() if line.strip()][:n], float).reshape(n, len(fields))
        return pd.DataFrame(table, columns=[f for f, _ in fields])
    order = "<" if kind == "binary_little_endian" else ">"
    p = np.frombuffer(body, np.dtype([(f, order + t) for f, t in fields]), n)
    return pd.DataFrame({f: p[f].astype(p.dtype[f].newbyteorder("=")) for f, _ in fields})


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """``x, y, z`` of PLY files, one task a file: scans of a survey are shared out by files."""

    def run(frames):
        for pdf in frames:
            for data in pdf["content"]:
                yield parse_ply(bytes(data))[["x", "y", "z"]].astype("f8")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(run, "x double, y double, z double")


def write_ply(points: pd.DataFrame, uri: str) -> None:
    """A binary PLY file of a table that fits one file."""
    p = points[["x", "y", "z"]].to_numpy("<f8")
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(p)}\n" + "".join(f"property double {c}\n" for c in "xyz") + "end_header\n"
    fs, path = filesystem(uri)
    with fs.open_output_stream(path) as f:
        f.write(head.encode() + p.tobytes())


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """ESRI ASCII grids as ``path, xmin, ymin, size, row, col, value``; row 0 is the south."""

    def run(frames):
        for pdf in frames:
            for name, text in zip(pdf["path"], pdf["content"], strict=True):
                lines = bytes(text).decode().split("\n")
                h = {w[0].lower(): float(w[1]) for w in (line.split() for line in lines[:6]) if len(w) == 2}
                start = len(h)
                rows, cols = int(h["nrows"]), int(h["ncols"])
                grid = np.array(" ".join(lines[start:]).split(), float).reshape(rows, cols)[::-1]
                half = h["cellsize"] / 2
                xmin = h.get("xllcorner", h.get("xllcenter", 0.0) - half)
                ymin = h.get("yllcorner", h.get("yllcenter", 0.0) - half)
                r, c = np.nonzero(grid != h.get("nodata_value", -9999.0))
                yield pd.DataFrame({"path": name, "xmin": xmin, "ymin": ymin, "size": h["cellsize"], "row": r, "col": c, "value": grid[r, c]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, xmin double, ymin double, size double, row long, col long, value double")


def write_ascii_grid(raster: DataFrame, path: str, size: float, origin=(0.0, 0.0), most: int = 4_000_000) -> int:
    """Tiles of a raster as ESRI ASCII grids, one file each, of at most ``most`` cells; the number of files."""
    side = int(most**0.5)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = int(pdf["row"].min()), int(pdf["col"].min())
        grid = np.full((int(pdf["row"].max()) - r0 + 1, int(pdf["col"].max()) - c0 + 1), -9999.0)
        grid[pdf["row"] - r0, pdf["col"] - c0] = pdf["value"]
        head = f"ncols {grid.shape[1]}\nnrows {grid.shape[0]}\nxllcorner {origin[0] + c0 * size!r}\nyllcorner {origin[1] + r0 * size!r}\ncellsize {size!r}\nNODATA_value -9999\n"
        fs, root = filesystem(path)
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/grid_{int(pdf['tr'].iloc[0])}_{int(pdf['tc'].iloc[0])}.asc") as f:
            f.write((head + "\n".join(" ".join(repr(float(v)) for v in line) for line in grid[::-1]) + "\n").encode())
        return pd.DataFrame({"cells": [len(pdf)]})

    tiles = raster.filter("value is not null").withColumns({"tr": F.floor(F.col("row") / side), "tc": F.floor(F.col("col") / side)})
    return tiles.groupBy("tr", "tc").applyInPandas(run, "cells long").count()


def read_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Features of GeoJSON files: ``feature, rings, attributes``."""
    schema = "feature long, rings array<array<struct<x:double,y:double>>>, attributes map<string,string>"

    def rings(g: dict) -> list:
        parts = {"Polygon": lambda c: c, "MultiPolygon": lambda c: [r for p in c for r in p]}
        if g["type"] not in parts:
            raise ValueError(f"{g['type']} is no polygon")
        out = parts[g["type"]](g["coordinates"])
        return [[(float(x), float(y)) for x, y, *_ in (r[:-1] if r[0] == r[-1] else r)] for r in out]

    text = spark.read.text(path, wholetext=True)

    @F.udf(f"array<struct<{schema.replace(' long', ':long').replace('rings ', 'rings:').replace('attributes ', 'attributes:').replace(', ', ',')}>>")
    def parse(content: str):
        return [(i, rings(f["geometry"]), {k: None if v is None else str(v) for k, v in (f.get("properties") or {}).items()}) for i, f in enumerate(json.loads(content)["features"])]

    return text.select(F.explode(parse("value")).alias("f")).select("f.*")


def read_sbet(spark: SparkSession, path: str) -> DataFrame:
    """Smoothed trajectories: records of 17 doubles, of which time, position and attitude are kept."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(frames):
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                d = np.frombuffer(bytes(data), "<f8").reshape(-1, 17)
                yield pd.DataFrame({"path": name, "t": d[:, 0], "latitude": np.degrees(d[:, 1]), "longitude": np.degrees(d[:, 2]), "z": d[:, 3], "roll": d[:, 7], "pitch": d[:, 8], "heading": d[:, 9]})

    return files.mapInPandas(run, "path string, t double, latitude double, longitude double, z double, roll double, pitch double, heading double")


def pack_sbet(rows: np.ndarray) -> bytes:
    """Records of 17 doubles, as bytes."""
    return b"".join(struct.pack("<17d", *r) for r in rows)
