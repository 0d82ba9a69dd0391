"""Web archives packaged in ZIP, read by ranges.

An archive holds ``archive/data.warc.gz`` (a gzip member for each WARC record),
``indexes/index.cdxj`` (a line for each record with its place) and
``datapackage.json``, all stored without compression of their own.  The reader
parses the end record, its ZIP64 form, the central directory and the members'
local headers, and then fetches single records by offset and length; nothing is
extracted and no archive is held whole.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import new_folder, stage

DATE = "2024-01-01T00:00:00Z"
WARC, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
#: Rows of the table of repeated payloads that may be sent to every executor (some 80 bytes each).
BROADCAST_ROWS = 500_000

MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("refers_to", T.LongType()),
    ]
)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP headers of its page and no payload."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:none"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode().split("\r\n")[1:])}, payload


class ArchiveWriter:
    """Collects records and closes with the whole archive."""

    def __init__(self):
        self.warc, self.index, self.size, self.count = [], [], 0, 0

    def add(self, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> None:
        packed = gzip.compress(record(page_id, url, payload, refers_to), 6, mtime=0)
        entry = {"page_id": page_id, "url": url, "digest": f"sha1:{digest(payload)}", "filename": WARC, "offset": self.size, "length": len(packed)}
        self.index.append(f"{page_id} {DATE} {json.dumps(entry)}\n")
        self.warc.append(packed)
        self.size += len(packed)
        self.count += 1

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
            for name, data in ((WARC, b"".join(self.warc)), (INDEX, "".join(self.index).encode()), (PACKAGE, json.dumps({"profile": "data-package", "records": self.count}).encode())):
                info = zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0))
                with z.open(info, "w", force_zip64=True) as f:
                    f.write(data)
        return out.getvalue()


class ArchiveReader:
    """Members of a ZIP archive by name, read through ``read_at(offset, length)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - 22 - 65535)
        tail = read_at(tail_at, size - tail_at)
        at = tail.rfind(b"PK\x05\x06")
        while at >= 0 and at + 22 + int.from_bytes(tail[at + 20 : at + 22], "little") != len(tail):
            at = tail.rfind(b"PK\x05\x06", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        entries, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
        if (entries == 0xFFFF or length == 0xFFFFFFFF or start == 0xFFFFFFFF) and tail[at - 20 : at - 16] == b"PK\x06\x07":
            (end64,) = struct.unpack("<Q", tail[at - 12 : at - 4])
            end = read_at(end64, 56)
            if end[:4] != b"PK\x06\x06":
                raise ValueError("damaged ZIP64 end record")
            entries, length, start = struct.unpack("<QQQ", end[32:56])
        self.members: dict[str, tuple[int, int, int]] = {}
        central, at = read_at(start, length), 0
        for _ in range(entries):
            if central[at : at + 4] != b"PK\x01\x02":
                raise ValueError("damaged central directory")
            flags, method = struct.unpack("<HH", central[at + 8 : at + 12])
            packed, size_, n, extra, note = struct.unpack("<IIHHH", central[at + 20 : at + 34])
            (local,) = struct.unpack("<I", central[at + 42 : at + 46])
            name = central[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            fields, stop = at + 46 + n, at + 46 + n + extra
            while fields + 4 <= stop:
                tag, width = struct.unpack("<HH", central[fields : fields + 4])
                if tag == 1:
                    wide = iter(struct.unpack(f"<{width // 8}Q", central[fields + 4 : fields + 4 + width // 8 * 8]))
                    size_ = next(wide) if size_ == 0xFFFFFFFF else size_
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                fields += 4 + width
            if method != 0 or packed != size_:
                raise ValueError(f"{name} is not stored")
            self.members[name] = (local, size_, -1)
            at = stop + note

    def place(self, name: str) -> tuple[int, int]:
        """Where a member's bytes begin, and how many there are."""
        local, size, at = self.members[name]
        if at < 0:
            head = self.read_at(local, 30)
            if head[:4] != b"PK\x03\x04":
                raise ValueError("damaged local header")
            n, extra = struct.unpack("<HH", head[26:30])
            at = local + 30 + n + extra
            self.members[name] = (local, size, at)
        return at, size

    def range(self, name: str, offset: int, length: int) -> bytes:
        at, size = self.place(name)
        if offset < 0 or offset + length > size:
            raise ValueError("outside the member")
        return self.read_at(at + offset, length)

    def entries(self, piece: int = 1 << 20) -> Iterator[dict]:
        """Index lines, read a piece at a time."""
        for name in sorted(m for m in self.members if m.startswith("indexes/") and m.endswith(".cdxj")):
            size, rest = self.place(name)[1], b""
            for at in range(0, size, piece):
                *lines, rest = (rest + self.range(name, at, min(piece, size - at))).split(b"\n")
                yield from (json.loads(x.split(b" ", 2)[2]) for x in lines if x)
            if rest:
                yield json.loads(rest.split(b" ", 2)[2])

    def record(self, entry: dict) -> tuple[dict[str, str], dict[str, str], bytes]:
        return parse_record(zlib.decompress(self.range(entry["filename"], entry["offset"], entry["length"]), 31))


def windowed(read: Callable[[int, int], bytes], window: int = 1 << 20) -> Callable[[int, int], bytes]:
    """Serves small reads from the last window read, so that neighbours cost one request."""
    held = [0, b""]

    def read_at(at: int, size: int) -> bytes:
        begin, data = held
        if not begin <= at or at + size > begin + len(data):
            held[:] = [at, read(at, max(size, window))]
            begin, data = held
        return data[at - begin : at - begin + size]

    return read_at


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``pages`` with ``refers_to``: the largest page_id that has the same payload, if another."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), body.alias("html"))
    sha = F.sha1(F.encode("html", "utf-8"))
    long_enough = F.octet_length("html") >= min_bytes
    groups = (
        keyed.filter(long_enough)
        .select(sha.alias("sha"), "page_id")
        .groupBy("sha")
        .agg(F.max("page_id").alias("last"), F.min("page_id").alias("first"))
        .filter("first <> last")
        .select("sha", "last")
    )
    groups = stage(groups, "payloads")
    side = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    found = keyed.withColumn("sha", F.when(long_enough, sha)).join(side, "sha", "left")
    return found.select("page_id", "url", "html", F.when(F.col("last") > F.col("page_id"), F.col("last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives; returns the manifest.

    Null html is an empty payload and a null url is kept as null in the index.
    Rows with a null page_id are responses and nothing refers to them; rows that
    repeat the largest page_id of a payload are all responses.  No rows give no
    archives.  Repeated tasks write other names, and the manifest has only those
    of tasks that counted.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")

    def run(batches):
        from pyarrow import fs as pafs

        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        writer = ArchiveWriter()

        def flush():
            nonlocal writer
            path = f"{root}/{part:06d}-{uuid.uuid4().hex}.wacz"
            data = writer.close()
            with fs.open_output_stream(path) as f:
                f.write(data)
            row = {"path": [path], "records": [writer.count], "bytes": [len(data)]}
            writer = ArchiveWriter()
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                page, url, body, refers = (c[i].as_py() for c in columns)
                writer.add(page, url, (body or "").encode(), refers)
                if writer.size >= archive_bytes:
                    yield flush()
        if writer.count:
            yield flush()

    rows = revisits(pages, min_bytes).select("page_id", "url", "html", "refers_to")
    return stage(rows.mapInArrow(run, MANIFEST), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the archives; digests of responses are verified."""
    names = [f.name for f in RECORDS]

    def run(batches):
        from pyarrow import fs as pafs

        fs, _ = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_file(path) as f:

                    def read(at, size, f=f):
                        f.seek(at)
                        return f.read(size)

                    archive = ArchiveReader(windowed(read), f.size())
                    for entry in list(archive.entries()):
                        warc, http, payload = archive.record(entry)
                        sha = warc["warc-payload-digest"].removeprefix("sha1:")
                        refers = warc.get("warc-refers-to")
                        if warc["warc-type"] == "response" and digest(payload) != sha:
                            raise ValueError(f"damaged record in {path}")
                        rows.append((entry["page_id"], entry["url"], int(http["content-length"]), sha, warc["warc-type"], int(refers[10:-1]) if refers else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()), strict=True)], names)

    tasks = max(1, manifest.count())  # one archive each; they have a like size
    return manifest.select("path").repartition(tasks, F.col("path")).mapInArrow(run, RECORDS)
