"""LAS files as a data source: ``spark.read.format("las")`` and ``df.write.format("las")``.

The driver only lists files.  A partition is a byte range of a file; its task
reads the header, goes on only if the header's box can meet the pushed filters,
and reads the records that begin in its range.  Filters are evaluated on their own
columns first; other columns are decoded for the rows that pass, and only those
that the schema asks for, by their offsets in the record::

    register(spark)
    spark.read.format("las").schema("x double, y double, z double").load(uri).filter("z > 20 and classification = 5")

Options: ``path``; ``rangeBytes``, the size of a partition's range (64 MB); for
writing, ``scale`` (0.001) and ``pointsPerFile`` (5,000,000).
"""

from __future__ import annotations

import operator
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from . import las
from .files import filesystem, listed, read_at

HEADER = 375
#: Records that are decoded at once.
RECORDS = 200_000
COMPARED: dict[type, Callable] = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}
#: Columns that may hold NaN, which sorts above all numbers in Spark: rows that a filter may keep go on to Spark.
MAY_BE_NAN = {"gps_time"}


def register(spark: SparkSession) -> None:
    """Make the format known to a session, and let filters reach Python sources."""
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class ByteRange(InputPartition):
    file_no: int
    path: str
    start: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class LasSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> T.StructType:
        return las.POINT

    def reader(self, schema: T.StructType) -> LasReader:
        return LasReader(self.options, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> LasWriter:
        return LasWriter(self.options, schema, overwrite)


class Records:
    """Columns of point records, decoded when they are asked for."""

    def __init__(self, data: bytes, head: dict, first: int, file_no: int):
        fields = las.FORMATS[head["point_format"]]
        dtype = np.dtype({"names": [f for f, _ in fields], "formats": [t for _, t in fields], "offsets": las.offsets(head["point_format"]), "itemsize": head["record_length"]})
        self.rows = np.frombuffer(data, dtype)
        self.place = first + np.arange(len(self.rows))
        self.head, self.file_no, self.new = head, file_no, head["point_format"] >= 6

    def keep(self, mask: np.ndarray) -> None:
        self.rows, self.place = self.rows[mask], self.place[mask]

    def column(self, name: str) -> np.ndarray | None:
        """Values of a column; none where the record format has none."""
        p, h = self.rows, self.head
        if name in ("x", "y", "z"):
            return p[name.upper()] * h[f"s{name}"] + h[f"o{name}"]
        if name == "pid":
            return (np.int64(self.file_no) << 40) + self.place
        if name == "file_no":
            return np.full(len(p), self.file_no, "i4")
        if name == "return_number":
            return (p["returns"] & 15 if self.new else p["bits"] & 7).astype("i2")
        if name == "number_of_returns":
            return (p["returns"] >> 4 if self.new else p["bits"] >> 3 & 7).astype("i2")
        if name == "classification":
            return (p["class"] if self.new else p["class"] & 31).astype("i2")
        if name == "scan_angle":
            return p["angle"] * (0.006 if self.new else 1.0)
        return p[name] if name in p.dtype.names else None


class LasReader(DataSourceReader):
    def __init__(self, options, schema: T.StructType):
        self.uri = options.get("path")
        self.range_bytes = int(options.get("rangeBytes", 64 << 20))
        known = {f.name: f.dataType for f in las.POINT}
        for f in schema:
            if known.get(f.name) != f.dataType:
                raise ValueError(f"column {f.name} of type {f.dataType.simpleString()} is not one of {las.POINT.simpleString()}")
        self.names = [f.name for f in schema]
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]):
        """Take comparisons of one column with constants; others stay with Spark."""
        for f in filters:
            if not isinstance(f, (*COMPARED, In, IsNotNull)) or len(f.attribute) != 1:
                yield f
                continue
            self.filters.append(f)
            if f.attribute[0] in MAY_BE_NAN and not isinstance(f, IsNotNull):
                yield f

    def partitions(self) -> list[ByteRange]:
        step = max(self.range_bytes, 1)
        return [ByteRange(i, path, a, min(a + step, size)) for i, (path, size) in enumerate(listed(self.uri, (".las",))) for a in range(0, size, step)]

    def may_match(self, head: dict) -> bool:
        """Whether points in the header's box can pass; a box may be off by rounding."""
        for f in self.filters:
            c = f.attribute[0]
            if c not in ("x", "y", "z") or isinstance(f, IsNotNull):
                continue
            low, high = head[f"{c}min"] - head[f"s{c}"], head[f"{c}max"] + head[f"s{c}"]
            values = f.value if isinstance(f, In) else [f.value]
            below = isinstance(f, LessThan | LessThanOrEqual)
            above = isinstance(f, GreaterThan | GreaterThanOrEqual)
            if not any(v is not None and (above or v >= low) and (below or v <= high) for v in values):
                # one-sided comparisons look at one side of the box only
                return False
        return True

    def passing(self, records: Records, f: Filter) -> np.ndarray:
        values = records.column(f.attribute[0])
        if values is None:  # all null: no comparison holds
            return np.zeros(len(records.rows), bool)
        if isinstance(f, IsNotNull):
            return np.ones(len(values), bool)
        if isinstance(f, In):
            mask = np.isin(values, [v for v in f.value if v is not None])
        else:
            mask = COMPARED[type(f)](values, f.value) if f.value is not None else np.zeros(len(values), bool)
        return mask | np.isnan(values) if f.attribute[0] in MAY_BE_NAN else mask

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        head = las.header(read_at(partition.path, 0, HEADER))
        if not self.may_match(head):
            return
        at, length = head["data_at"], head["record_length"]
        # the records whose first byte is in the range
        first = max(0, -(-(partition.start - at) // length))
        last = min(head["n_points"], max(0, -(-(partition.end - at) // length)))
        kinds = {f.name: to_arrow_type(f.dataType) for f in las.POINT}
        for a in range(first, last, RECORDS):
            n = min(RECORDS, last - a)
            records = Records(read_at(partition.path, at + a * length, n * length), head, a, partition.file_no)
            for f in self.filters:
                records.keep(self.passing(records, f))
            n = len(records.rows)
            if n:
                cols = [(c, records.column(c)) for c in self.names]
                arrays = [pa.nulls(n, kinds[c]) if v is None else pa.array(np.ascontiguousarray(v)).cast(kinds[c]) for c, v in cols]
                yield pa.RecordBatch.from_arrays(arrays, names=self.names)


class LasWriter(DataSourceArrowWriter):
    """Each task writes files of at most ``pointsPerFile`` points; they get their names when the job commits."""

    def __init__(self, options, schema: T.StructType, overwrite: bool):
        if missing := {"x", "y", "z"} - set(schema.names):
            raise ValueError(f"points need columns {sorted(missing)}")
        self.uri, self.overwrite = options["path"], overwrite
        self.scale, self.most = float(options.get("scale", 0.001)), int(options.get("pointsPerFile", 5_000_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        fs, root = filesystem(self.uri)
        fs.create_dir(root, recursive=True)
        part, files, held, n = TaskContext.get().partitionId(), [], [], 0

        def flush(rows: pa.Table) -> None:
            name = f"{root}/part-{part:06d}-{len(files):04d}.las"
            hidden = f"{root}/_{part:06d}-{len(files):04d}-{uuid.uuid4().hex[:8]}.tmp"
            with fs.open_output_stream(hidden) as f:
                f.write(las.encode(rows, self.scale))
            files.append((hidden, name))

        for batch in iterator:
            while batch.num_rows:
                take = batch.slice(0, self.most - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == self.most:
                    flush(pa.Table.from_batches(held))
                    held, n = [], 0
        if held:
            flush(pa.Table.from_batches(held))
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = filesystem(self.uri)
        new = [pair for m in messages if m for pair in m.files]
        if self.overwrite:
            for path, _ in listed(self.uri, (".las",)):
                fs.delete_file(filesystem(path)[1])
        tag = "" if self.overwrite else uuid.uuid4().hex[:8] + "-"
        for hidden, name in new:
            folder, base = name.rsplit("/", 1)
            fs.move(hidden, f"{folder}/{tag}{base}")

    def abort(self, messages: list) -> None:
        fs, _ = filesystem(self.uri)
        for m in messages:
            for hidden, _ in m.files if m else []:
                fs.delete_file(hidden)
