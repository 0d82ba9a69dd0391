"""Token ids as wavelet matrices, one compressed file for each shard.

A shard file holds the ids of consecutive documents as bit-planes, the highest
bit first.  Below each plane the ids stand as its stable division put them:
zeros first.  With the number of ones before every block of 512 bits, a plane
answers rank in one step, and so the file answers ``access(i)``, ``count(id)``
and ``select(id, n)`` from the bytes of a few blocks a plane, by range reads.

File format (little-endian): magic ``PGWM0001``; u32 documents, u32 planes;
u64 tokens; per document i64 id and u64 tokens (a flag bit 63 marks a null id);
per plane u64 zeros, then u32 rank of each block, then the bits, lowest first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, new_folder, stage
from .tokens import SLICE_BYTES, encoder, tokenizer_path

MAGIC = b"PGWM0001"
BLOCK = 512
NULL = 1 << 63

MANIFEST = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_docs", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)
DOCS = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def build(doc_ids: list, sizes: list[int], ids: np.ndarray) -> bytes:
    """The file of a shard."""
    n = len(ids)
    planes = max(1, int(ids.max()).bit_length()) if n else 1
    head = np.empty((len(doc_ids), 2), "<u8")
    head[:, 0] = np.array([d or 0 for d in doc_ids], "<i8").view("<u8")
    head[:, 1] = [s | (NULL if d is None else 0) for d, s in zip(doc_ids, sizes, strict=True)]
    out = [MAGIC, struct.pack("<IIQ", len(doc_ids), planes, n), head.tobytes()]
    values = ids.astype("<u2" if planes <= 16 else "<u4")
    width = -(-n // BLOCK) * BLOCK // 8
    for level in range(planes - 1, -1, -1):
        bits = (values >> level & 1).astype(bool)
        packed = np.zeros(width, "u1")
        packed[: -(-n // 8)] = np.packbits(bits, bitorder="little")
        ones = np.bitwise_count(packed.view("<u8")).reshape(-1, BLOCK // 64).sum(1, dtype="u8")
        ranks = np.zeros(len(ones), "<u4")
        np.cumsum(ones[:-1], out=ranks[1:], dtype="u4")
        out += [struct.pack("<Q", n - int(ones.sum())), ranks.tobytes(), packed.tobytes()]
        values = np.concatenate([values[~bits], values[bits]])
    return b"".join(out)


class Shard:
    """A shard file, read through ``read_at(offset, length)``; nothing is kept whole."""

    def __init__(self, read_at: Callable[[int, int], bytes]):
        self.read_at = read_at
        head = read_at(0, 24)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        self.n_docs, self.planes, self.n = struct.unpack("<IIQ", head[8:])
        self.blocks = -(-self.n // BLOCK)
        self.first = 24 + 16 * self.n_docs
        self.step = 8 + self.blocks * (4 + BLOCK // 8)

    @classmethod
    def of(cls, data: bytes) -> Shard:
        return cls(lambda at, size: data[at : at + size])

    def docs(self) -> tuple[list, np.ndarray]:
        table = np.frombuffer(self.read_at(24, 16 * self.n_docs), "<u8").reshape(-1, 2)
        ids, null = table[:, 0].view("<i8").tolist(), table[:, 1] >> np.uint64(63)
        return [None if x else d for d, x in zip(ids, null.tolist(), strict=True)], (table[:, 1] & np.uint64(NULL - 1)).astype("i8")

    def _plane(self, p: int) -> tuple[int, int, int]:
        at = self.first + p * self.step
        (zeros,) = struct.unpack("<Q", self.read_at(at, 8))
        return zeros, at + 8, at + 8 + 4 * self.blocks

    def _rank(self, plane: tuple[int, int, int], i: int) -> tuple[int, int]:
        """Ones before i, and the bit at i."""
        if i >= self.blocks * BLOCK:
            return self.n - plane[0], 0
        block, rest = divmod(i, BLOCK)
        (ones,) = struct.unpack("<I", self.read_at(plane[1] + 4 * block, 4))
        word = int.from_bytes(self.read_at(plane[2] + block * BLOCK // 8, BLOCK // 8), "little")
        return ones + (word & ((1 << rest) - 1)).bit_count(), word >> rest & 1

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for p in range(self.planes):
            plane = self._plane(p)
            ones, bit = self._rank(plane, i)
            value = value << 1 | bit
            i = plane[0] + ones if bit else i - ones
        return value

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token among the first ``end`` ids."""
        if token < 0 or token >> self.planes:
            return 0
        lo, hi = 0, min(end, self.n)
        for p in range(self.planes):
            plane = self._plane(p)
            a, b = self._rank(plane, lo)[0], self._rank(plane, hi)[0]
            lo, hi = (plane[0] + a, plane[0] + b) if token >> (self.planes - 1 - p) & 1 else (lo - a, hi - b)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _find(self, plane: tuple[int, int, int], bit: int, nth: int) -> int:
        """Place of the bit number ``nth`` (from 0) of its kind in a plane: its block by the ranks, then in the block."""

        def before(block: int) -> int:
            (ones,) = struct.unpack("<I", self.read_at(plane[1] + 4 * block, 4))
            return ones if bit else block * BLOCK - ones

        lo, hi = 0, self.blocks - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            if before(mid) <= nth:
                lo = mid
            else:
                hi = mid - 1
        bits = np.unpackbits(np.frombuffer(self.read_at(plane[2] + lo * BLOCK // 8, BLOCK // 8), "u1"), bitorder="little")
        return lo * BLOCK + int(np.flatnonzero(bits == bit)[nth - before(lo)])

    def select(self, token: int, nth: int) -> int:
        """Place of the occurrence number ``nth`` (from 0); -1 if there are fewer."""
        if nth < 0 or token < 0 or token >> self.planes:
            return -1
        lo, hi, way = 0, self.n, []
        for p in range(self.planes):
            plane, bit = self._plane(p), token >> (self.planes - 1 - p) & 1
            a, b = self._rank(plane, lo)[0], self._rank(plane, hi)[0]
            lo, hi = (plane[0] + a, plane[0] + b) if bit else (lo - a, hi - b)
            way.append((plane, bit))
        if lo + nth >= hi:
            return -1
        at = lo + nth  # where the lowest plane's division put it; up again, plane by plane
        for plane, bit in reversed(way):
            at = self._find(plane, bit, at - plane[0] if bit else at)
        return at

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        dtype = "<u2" if self.planes <= 16 else "<u4"
        values = np.zeros(self.n, dtype)
        for p in range(self.planes - 1, -1, -1):
            zeros, _, at = self._plane(p)
            bits = np.unpackbits(np.frombuffer(self.read_at(at, self.blocks * BLOCK // 8), "u1"), bitorder="little", count=self.n).view(bool)
            if p < self.planes - 1:
                up = np.empty(self.n, dtype)
                up[~bits] = values[:zeros]
                up[bits] = values[zeros:]
                values = up
            values |= bits.astype(dtype) << (self.planes - 1 - p)
        return values.astype("<u4")


def filesystem(uri: str):
    """The file system of a shared folder and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, shard_tokens: int) -> DataFrame:
    """Encode ``docs(doc_id, text)`` in order of doc_id and write shard files.

    Returns the manifest.  A repeated task writes files under other names, and
    the manifest names only those of the task that counted.
    """
    arrow_names = [f.name for f in MANIFEST]

    def run(batches):
        import uuid

        enc = encoder(tokenizer_path(tokenizer), False)
        end = end_id.to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        before = shard = total = 0
        ids, sizes, raw = [], [], []

        def flush():
            nonlocal before, shard, total, ids, sizes, raw
            path = f"{root}/{part:06d}-{shard:06d}-{uuid.uuid4().hex[:8]}.wm"
            with fs.open_output_stream(path) as f:
                f.write(build(ids, sizes, np.frombuffer(b"".join(raw), "<u4")))
            row = pa.RecordBatch.from_pydict(dict(zip(arrow_names, [[part], [shard], [before], [total], [len(ids)], [path]], strict=True)))
            before, shard = before + total, shard + 1
            total, ids, sizes, raw = 0, [], [], []
            return row

        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                rows = batch.slice(i, step)
                for doc, x in zip(rows.column(0).to_pylist(), enc.encode_all(rows.column(1).to_pylist()), strict=True):
                    ids.append(doc)
                    sizes.append(len(x) // 4 + 1)
                    raw += (x, end)
                    total += sizes[-1]
                    if total >= shard_tokens:
                        yield flush()
        if ids:
            yield flush()

    order = [F.col("doc_id").asc_nulls_first(), F.col("place")]
    ordered = (
        docs.select("doc_id", F.col("text").cast("string").alias("text"))
        .withColumn("place", F.xxhash64("text"))  # equal or null ids are dealt over tasks too
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "text")
    )
    bounded_batches(docs.sparkSession)
    return ordered.mapInArrow(run, MANIFEST)


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """Documents from the files: ``doc_id, start, n_tokens, ids_crc32``.

    Starts count from the file's partition; the sums of the partitions before
    it, one number each, are added by a join.
    """
    names = [f.name for f in DOCS]

    def run(batches):
        fs, _ = filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["path"]) as f:
                    shard = Shard(lambda at, size, f=f: (f.seek(at), f.read(size))[1])
                    docs, sizes = shard.docs()
                    data = shard.decode().tobytes()
                ends = np.cumsum(sizes)
                starts = ends - sizes
                crc = [zlib.crc32(data[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [[row["part"]] * len(docs), docs, starts + row["before"], sizes, crc]
                yield pa.RecordBatch.from_pydict(dict(zip(names, cols, strict=True)))

    tasks = max(1, -(-manifest.count() // 4))  # a few files each, whatever their sizes
    sums = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    from pyspark.sql import Window

    base = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    # one row for each writing task, a few bytes each: their number is that of the shuffle's partitions
    return (
        manifest.repartition(tasks, F.col("path"))
        .mapInArrow(run, DOCS)
        .join(F.broadcast(base), "part")
        .select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")
    )


def store_tokens(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 2,
    shard_tokens: int = 1 << 20,
) -> tuple[DataFrame, str]:
    """Write the shards of ``docs`` and return their manifest and folder.

    A null or empty text is the end id alone.  Null ids come first, rows with
    equal ids follow each other by a hash of their text; no rows give no files.  A document is
    never divided, so a file holds ``shard_tokens`` and at most one document.
    """
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return stage(write_shards(docs, folder, tokenizer, end_id, shard_tokens), "token-manifest"), folder
