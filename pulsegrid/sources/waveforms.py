"""Digitised pulses in LAS files: batch and streaming source, and sink.

``format("las_waveforms")`` reads point formats 4, 5, 9 and 10 with their packets
in the file or in a ``.wdp`` file beside it, one row a waveform::

    register(spark)
    spark.read.format("las_waveforms").load(uri)
    spark.readStream.format("las_waveforms").load(uri)       # files as they arrive
    pulses.write.format("las_waveforms").mode("append").save(uri)

Consecutive records that point to one packet are the returns of one pulse and give
one waveform, with the record that comes first.  Files are cut into ranges of
records; a waveform belongs to the range in which its first record stands, so none
is split or given twice.  A file has to be whole when it gets its name.

The stream's offset holds the records taken of each file.  A batch takes all that
has come since; a task takes ``records`` of them (100,000) at most.

Columns: ``path, record`` name the first record; ``x, y, z`` is its point; sample i
stands at ``point + (location_ps - i * interval_ps) * (vx, vy, vz)``.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

from .files import filesystem, listed, read_at

# Point formats with waveforms of the LAS specification, as bytes before the waveform fields, and those fields.
BEFORE = {4: 28, 5: 34, 9: 30, 10: 38}
TIME_AT = {4: 20, 5: 20, 9: 22, 10: 22}
WAVE = [("descriptor", "u1"), ("at", "<u8"), ("size", "<u4"), ("location", "<f4"), ("vx", "<f4"), ("vy", "<f4"), ("vz", "<f4")]
WAVE_BYTES = 29
DESCRIPTOR = "<BBIIdd"
PACKETS_ID, FIRST_DESCRIPTOR_ID = 65535, 100
LONG_RECORD_HEADER = 60

WAVEFORM = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("record", T.LongType()),
        T.StructField("returns", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("gps_time", "x", "y", "z", "location_ps", "vx", "vy", "vz")],
        T.StructField("interval_ps", T.LongType()),
        T.StructField("samples", T.ArrayType(T.FloatType())),
    ]
)
#: Packets are read together if what lies between them is no more than their own bytes times this.
LOOSE = 4


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WaveformSource)


@dataclass
class Range(InputPartition):
    path: str
    first: int
    last: int


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class WaveformSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "las_waveforms"

    def schema(self) -> T.StructType:
        return WAVEFORM

    def reader(self, schema: T.StructType) -> BatchReader:
        return BatchReader(self.options)

    def streamReader(self, schema: T.StructType) -> StreamReader:
        return StreamReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options, overwrite)


def header(path: str) -> dict:
    """What reading the records of a file takes: layout, coordinates, and where its packets are."""
    raw = read_at(path, 0, 375)
    if raw[:4] != b"LASF":
        raise ValueError(f"{path} is not a LAS file")
    (encoding,) = struct.unpack_from("<H", raw, 6)
    size, data_at, n_vlr, fmt, length, n = struct.unpack_from("<HIIBHI", raw, 94)
    if fmt & 0x80:
        raise ValueError("compressed points (LAZ) cannot be read here")
    if fmt not in BEFORE:
        raise ValueError(f"{path}: point format {fmt} has no waveforms")
    if raw[25] >= 4:
        n = struct.unpack_from("<Q", raw, 247)[0] or n
    scale, offset = struct.unpack_from("<3d", raw, 131), struct.unpack_from("<3d", raw, 155)
    (packets_at,) = struct.unpack_from("<Q", raw, 227)
    outside = bool(encoding & 4) and not encoding & 2
    wdp = path[: path.rfind(".")] + ".wdp"
    out = {"fmt": fmt, "length": length, "n": n, "data_at": data_at, "scale": scale, "offset": offset}
    out |= {"packets": wdp if outside else path, "packets_at": 0 if outside else packets_at}
    vlrs = read_at(path, size, data_at - size)
    at, kinds = 0, {}
    for _ in range(n_vlr):
        record_id, payload = struct.unpack_from("<HH", vlrs, at + 18)
        if vlrs[at + 2 : at + 18].rstrip(b"\0") == b"LASF_Spec" and FIRST_DESCRIPTOR_ID <= record_id < FIRST_DESCRIPTOR_ID + 255:
            bits, packed, samples, interval, gain, base = struct.unpack_from(DESCRIPTOR, vlrs, at + 54)
            if packed:
                raise ValueError(f"{path}: compressed packets")
            if bits not in (8, 16, 32):
                raise ValueError(f"{path}: {bits} bits a sample")
            kinds[record_id - FIRST_DESCRIPTOR_ID + 1] = (f"<u{bits // 8}", samples, interval, gain, base)
        at += 54 + payload
    return out | {"descriptors": kinds}


def ranges(path: str, first: int, last: int, step: int) -> list[Range]:
    return [Range(path, a, min(a + step, last)) for a in range(first, last, step)]


def waveforms(part: Range) -> Iterator[pa.RecordBatch]:
    """Waveforms whose first record stands in the range."""
    h = header(part.path)
    before = BEFORE[h["fmt"]]
    fields = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("gps_time", "<f8"), *WAVE]
    places = [0, 4, 8, TIME_AT[h["fmt"]], *np.cumsum([before, *[np.dtype(t).itemsize for _, t in WAVE[:-1]]]).tolist()]
    dtype = np.dtype({"names": [n for n, _ in fields], "formats": [t for _, t in fields], "offsets": places, "itemsize": h["length"]})

    def records(a: int, b: int) -> np.ndarray:
        return np.frombuffer(read_at(part.path, h["data_at"] + a * h["length"], (b - a) * h["length"]), dtype)

    lead = 1 if part.first else 0  # the record before tells whether the first goes on with its packet
    r = records(part.first - lead, part.last)
    while part.first - lead + len(r) < h["n"]:  # and so do those behind
        end = part.first - lead + len(r)
        more = records(end, min(end + 1000, h["n"]))
        same = (more["at"] == r["at"][-1]) & (more["descriptor"] == r["descriptor"][-1]) & (r["descriptor"][-1] > 0)
        n = len(more) if same.all() else int(same.argmin())
        r = np.concatenate([r, more[:n]])
        if n < len(more):
            break
    held = r["descriptor"] > 0
    starts = held.copy()
    starts[1:] &= ~(held[:-1] & (r["at"][1:] == r["at"][:-1]) & (r["descriptor"][1:] == r["descriptor"][:-1]))
    group = np.cumsum(starts)
    count = np.bincount(group[held], minlength=group[-1] + 1 if len(group) else 1)
    mine = starts & (np.arange(len(r)) >= lead)
    where = np.flatnonzero(mine)
    if not len(where):
        return
    w = r[where]
    samples: list = [None] * len(w)
    order = np.argsort(w["at"], kind="stable")
    at, size = w["at"][order].astype("i8"), w["size"][order].astype("i8")
    a = 0
    while a < len(order):
        # packets that lie close enough come with one read
        b, own = a + 1, int(size[a])
        while b < len(order) and b - a < 50_000 and at[b] + size[b] - at[a] <= LOOSE * (own + size[b]):
            own += int(size[b])
            b += 1
        raw = read_at(h["packets"], h["packets_at"] + int(at[a]), int((at[a:b] + size[a:b]).max() - at[a]))
        for i in range(a, b):
            kind, n, _, gain, base = h["descriptors"][int(w["descriptor"][order[i]])]
            x = np.frombuffer(raw, kind, n, int(at[i] - at[a]))
            samples[order[i]] = (x * gain + base).astype("f4")
        a = b
    n = np.array([len(s) for s in samples])
    edges = np.concatenate([[0], np.cumsum(n)]).astype("i4")
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.concatenate(samples)))
    xyz = [pa.array(w[c] * s + o) for c, s, o in zip("XYZ", h["scale"], h["offset"], strict=True)]
    wave = [pa.array(w[c].astype("f8")) for c in ("location", "vx", "vy", "vz")]
    interval = pa.array([h["descriptors"][d][2] for d in w["descriptor"].tolist()], pa.int64())
    record = pa.array(part.first - lead + where.astype("i8"))
    returns = pa.array(count[group[where]].astype("i4"))
    cols = [pa.array([part.path] * len(w)), record, returns, pa.array(w["gps_time"].astype("f8")), *xyz, *wave, interval, lists]
    yield pa.RecordBatch.from_arrays(cols, names=WAVEFORM.names)


class BatchReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.step = options.get("path"), int(options.get("records", 100_000))

    def partitions(self) -> list[Range]:
        return [r for path, _ in listed(self.uri, (".las",)) for r in ranges(path, 0, header(path)["n"], self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return waveforms(partition)


class StreamReader(DataSourceStreamReader):
    """Offsets are ``{path: records}``; a header is read when its file first shows up."""

    def __init__(self, options):
        self.uri, self.step = options.get("path"), int(options.get("records", 100_000))
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        for path, _ in listed(self.uri, (".las",)):
            if path not in self.known:
                self.known[path] = header(path)["n"]
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [r for path, n in sorted(end.items()) for r in ranges(path, start.get(path, 0), n, self.step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return waveforms(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept for offsets that are done."""


def encode(rows: pa.Table, scale: float) -> bytes:
    """A LAS 1.4 file of point format 9 with packets inside; a row gives ``returns`` records of one packet.

    Samples that are whole numbers from 0 to 65,535 stay as they are; the others
    of a length and interval are spread over 16 bits, off by half a step at most.
    """
    n = rows.num_rows
    xyz = np.stack([rows[c].to_numpy().astype(float) for c in "xyz"], 1)
    lists = rows["samples"].combine_chunks()
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("f8")
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
    starts = np.cumsum(lengths) - lengths
    odd = ~((flat == np.floor(flat)) & (flat >= 0) & (flat <= 65535))
    whole = np.diff(np.cumsum(np.r_[0, odd])[np.c_[starts, starts + lengths]], axis=1)[:, 0] == 0
    interval = rows["interval_ps"].to_numpy()
    kinds, kind = np.unique(np.column_stack([lengths, interval, whole]).reshape(n, 3), axis=0, return_inverse=True)
    if len(kinds) > 255:
        raise ValueError("more than 255 kinds of packets in a file; write fewer waveforms a file")
    vlrs, codes, descriptor = [], np.empty(len(flat), "<u2"), np.zeros(n, "u1")
    for k, (length, step, plain) in enumerate(kinds.tolist()):
        own = np.flatnonzero(kind.reshape(-1) == k)
        where = starts[own][:, None] + np.arange(length)
        every = flat[where]
        base = 0.0 if plain or not every.size else float(every.min())
        gain = 1.0 if plain or not every.size else (float(every.max()) - base) / 65535 or 1.0
        payload = struct.pack(DESCRIPTOR, 16, 0, length, step, gain, base)
        vlrs.append(struct.pack("<H16sHH32s", 0, b"LASF_Spec", FIRST_DESCRIPTOR_ID + k, len(payload), b"waveform packet") + payload)
        codes[where] = np.rint((every - base) / gain).astype("<u2")
        descriptor[own] = k + 1
    sizes = 2 * lengths
    at = LONG_RECORD_HEADER + np.cumsum(sizes) - sizes
    returns = np.maximum(1, rows["returns"].to_numpy()) if "returns" in rows.column_names else np.ones(n, "i8")
    row = np.repeat(np.arange(n), returns)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(returns) - returns, returns) + 1
    low, high = (xyz.min(0), xyz.max(0)) if n else (np.zeros(3), np.zeros(3))
    origin = np.floor(low)
    length = BEFORE[9] + WAVE_BYTES
    fields = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("returns", "u1", 14), ("gps_time", "<f8", 22)]
    place = BEFORE[9]
    for c, t in WAVE:
        fields.append((c, t, place))
        place += np.dtype(t).itemsize
    p = np.zeros(len(row), np.dtype({"names": [f[0] for f in fields], "formats": [f[1] for f in fields], "offsets": [f[2] for f in fields], "itemsize": length}))
    for i, c in enumerate("XYZ"):
        p[c] = np.rint((xyz[row, i] - origin[i]) / scale)
    p["returns"] = np.minimum(rank, 15) | np.minimum(returns[row], 15) << 4
    p["gps_time"] = rows["gps_time"].to_numpy()[row]
    p["descriptor"], p["at"], p["size"] = descriptor[row], at[row], sizes[row]
    for c, name in (("location", "location_ps"), ("vx", "vx"), ("vy", "vy"), ("vz", "vz")):
        p[c] = rows[name].to_numpy()[row]
    block = b"".join(vlrs)
    points = p.view("u1")
    packets_at = 375 + len(block) + len(points)
    h = bytearray(375)
    h[:4] = b"LASF"
    struct.pack_into("<H", h, 6, 2)
    h[24:26] = bytes([1, 4])
    struct.pack_into("<HIIBHI", h, 94, 375, 375 + len(block), len(vlrs), 9, length, 0)
    struct.pack_into("<3d3d", h, 131, *[scale] * 3, *origin)
    struct.pack_into("<6d", h, 179, high[0], low[0], high[1], low[1], high[2], low[2])
    struct.pack_into("<QQIQ", h, 227, packets_at, packets_at, 1, len(row))
    packets = codes.view("u1")
    long_record = struct.pack("<H16sHQ32s", 0, b"LASF_Spec", PACKETS_ID, len(packets), b"waveform data packets")
    return b"".join([h, block, points, long_record, packets])


class Writer(DataSourceArrowWriter):
    """Files of at most ``waveformsPerFile`` pulses; they get their names when the job commits."""

    def __init__(self, options, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.scale, self.most = float(options.get("scale", 0.001)), int(options.get("waveformsPerFile", 200_000))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.uri)
        fs.create_dir(root, recursive=True)
        files, held, n = [], [], 0

        def flush() -> None:
            tag = uuid.uuid4().hex[:12]
            with fs.open_output_stream(f"{root}/_{tag}.tmp") as f:
                f.write(encode(pa.Table.from_batches(held), self.scale))
            files.append((f"{root}/_{tag}.tmp", f"{root}/{tag}.las"))
            held.clear()

        for batch in iterator:
            while batch.num_rows:
                take = batch.slice(0, self.most - n)
                batch = batch.slice(take.num_rows)
                held.append(take)
                n += take.num_rows
                if n == self.most:
                    flush()
                    n = 0
        if held:
            flush()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, _ = filesystem(self.uri)
        if self.overwrite:
            for path, _ in listed(self.uri, (".las",)):
                fs.delete_file(filesystem(path)[1])
        for m in messages:
            for hidden, name in m.files if m else []:
                fs.move(hidden, name)

    def abort(self, messages: list) -> None:
        fs, _ = filesystem(self.uri)
        for m in messages:
            for hidden, _ in m.files if m else []:
                fs.delete_file(hidden)


def sample_points(found: DataFrame) -> DataFrame:
    """A row a sample with its place in space: ``path, record, i, value, x, y, z``."""
    t = F.col("location_ps") - F.col("i") * F.col("interval_ps")
    each = found.select("path", "record", "x", "y", "z", "location_ps", "interval_ps", "vx", "vy", "vz", F.posexplode("samples").alias("i", "value"))
    return each.select("path", "record", "i", "value", *[(F.col(c) + t * F.col(f"v{c}")).alias(c) for c in "xyz"])


def noise(found: DataFrame, sigmas: float = 3.0, rounds: int = 50) -> DataFrame:
    """``path, record, background, noise`` of each waveform.

    Median and scaled absolute deviation, taken again without samples more than
    ``sigmas`` deviations above until none goes; then mean and deviation of what
    lies within that band, the latter made up for the cut tails of a normal
    curve.  An empty waveform has neither.
    """
    import math

    edge = math.sqrt(2 / math.pi) * sigmas * math.exp(-sigmas * sigmas / 2) / math.erf(sigmas / math.sqrt(2))
    cut = math.sqrt(1 - edge)  # deviation of a normal curve between the sigmas

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            out = []
            for s in lists:
                x = np.asarray(s.as_py() or [], "f8")
                x = x[np.isfinite(x)]
                if not len(x):
                    out.append((None, None))
                    continue
                kept = x
                for _ in range(rounds):
                    mid = np.median(kept)
                    dev = 1.4826 * np.median(np.abs(kept - mid))
                    fewer = kept[kept <= mid + sigmas * dev]
                    if len(fewer) == len(kept):
                        break
                    kept = fewer
                band = x[np.abs(x - mid) <= sigmas * dev]
                out.append((float(band.mean()), float(band.std()) / cut))
            cols = [batch.column(0), batch.column(1), pa.array([a for a, _ in out], pa.float64()), pa.array([b for _, b in out], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["path", "record", "background", "noise"])

    return found.select("path", "record", "samples").mapInArrow(run, "path string, record long, background double, noise double")
