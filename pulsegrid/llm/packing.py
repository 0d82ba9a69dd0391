"""Harmonic packing of documents into sequences of a fixed capacity.

With capacity C, class k takes pieces of more than C/(k+1) and at most C/k ids,
and a bin of class k takes exactly k pieces, whatever their documents.  A worker
therefore fills bins without looking at other workers: there is no shuffle, and
what it holds is one open bin for each class.

Documents may be cut, which removes the method's usual loss: a piece is kept
whole only if k such pieces leave at most ``slack`` of the capacity; otherwise
its first C//(k+1) ids, which fill a slot of the next class exactly, are cut
off and the rest is classed anew.  Pieces beyond the last class go to a bin
that is filled in order (as the method packs its last class).  At the end of a
partition, what stands in open bins goes the same way, and the last such bin is
cut at powers of two, so that it needs no padding either.
"""

from __future__ import annotations

import zlib

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, give_back
from .tokens import SLICE_BYTES, encoder, tokenizer_path

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("sequence_tokens", T.LongType()),
    ]
)


class Packer:
    """Bins of one worker.  A piece is (document, start, ids as bytes, document's ids)."""

    def __init__(self, capacity: int, classes: int, slack: float, first_id: int):
        self.capacity, self.classes = capacity, classes
        self.loss = int(slack * capacity)
        self.open: list[list] = [[] for _ in range(classes + 1)]
        self.tail: list = []
        self.tail_size = 0
        self.next_id = first_id
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        at, total = 0, sum(len(p[2]) for p in pieces) // 4
        for doc, start, ids, n in pieces:
            size = len(ids) // 4
            self.rows.append((doc, start, size, ids, n, self.next_id, at, total))
            at += size
        self.next_id += 1

    def fill(self, piece: tuple) -> None:
        """Into the bin that is filled in order, cut where it is full."""
        doc, start, ids, n = piece
        while ids:
            room = (self.capacity - self.tail_size) * 4
            self.tail.append((doc, start, ids[:room], n))
            self.tail_size += len(ids[:room]) // 4
            start, ids = start + room // 4, ids[room:]
            if self.tail_size == self.capacity:
                self.close(self.tail)
                self.tail, self.tail_size = [], 0

    def add(self, doc: int | None, ids: bytes) -> None:
        c, n, at = self.capacity, len(ids) // 4, 0
        while n - at >= c:
            self.close([(doc, at, ids[at * 4 : (at + c) * 4], n)])
            at += c
        while at < n:
            left = n - at
            k = c // left
            if k > self.classes or k == self.classes and c - k * left > self.loss:
                self.fill((doc, at, ids[at * 4 :], n))
                return
            size = left
            if c - k * left > self.loss:
                k += 1
                size = c // k
            self.open[k].append((doc, at, ids[at * 4 : (at + size) * 4], n))
            if len(self.open[k]) == k:
                self.close(self.open[k])
                self.open[k] = []
            at += size

    def finish(self) -> None:
        for pieces in self.open:
            for p in pieces:
                self.fill(p)
        rest, size = self.tail, self.tail_size
        self.tail, self.tail_size = [], 0
        while size:
            room = 1 << (size.bit_length() - 1)
            size -= room
            taken = []
            while room:
                doc, start, ids, n = rest[0]
                part = ids[: room * 4]
                taken.append((doc, start, part, n))
                room -= len(part) // 4
                if len(part) == len(ids):
                    rest.pop(0)
                else:
                    rest[0] = (doc, start + len(part) // 4, ids[len(part) :], n)
            self.close(taken)
        self.open = [[] for _ in range(self.classes + 1)]

    def take(self, with_ids: bool) -> dict[str, list]:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
        out = dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens"), cols, strict=True))
        if with_ids:
            out["ids"] = out["ids_crc32"]
        out["ids_crc32"] = [zlib.crc32(x) for x in out["ids_crc32"]]
        return out


def pack(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    capacity: int = 2048,
    classes: int = 64,
    slack: float = 1 / 64,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)``, each id of each document in one of them.

    A null or empty text is the end id alone.  A null ``doc_id`` stays null and
    rows with equal ids are packed each for itself; no rows give no pieces.
    Other columns are ignored.  ``sequence_id`` holds the partition in its high
    32 bits.  ``with_ids`` adds the piece's ids as little-endian 32-bit bytes.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([*PIECE, T.StructField("ids", T.BinaryType())]) if with_ids else PIECE
    arrow = to_arrow_schema(schema)

    def run(batches):
        give_back()
        enc = encoder(tokenizer_path(tokenizer), True)
        end = end_id.to_bytes(4, "little")
        packer = Packer(capacity, classes, slack, TaskContext.get().partitionId() << 32)
        for batch in batches:
            step = max(1, int(batch.num_rows * SLICE_BYTES / max(1, batch.nbytes)))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode_all(part.column(1).to_pylist()), strict=True):
                    packer.add(doc, ids + end)
                if packer.rows:
                    yield pa.RecordBatch.from_pydict(packer.take(with_ids), schema=arrow)
        packer.finish()
        yield pa.RecordBatch.from_pydict(packer.take(with_ids), schema=arrow)
        give_back()

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)


def sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """Whole sequences from pieces with ids: ``sequence_id, ids, n_tokens, docs``.

    ``ids`` is padded to the capacity unless its length is a power of two.
    """
    n = F.max("sequence_tokens")

    @F.udf(T.ArrayType(T.IntegerType()))
    def join(parts, total):
        import numpy as np

        ids = np.frombuffer(b"".join(bytes(p["ids"]) for p in parts), "<u4").astype("i4")
        size = total if total & (total - 1) == 0 else capacity
        return np.concatenate([ids, np.full(size - total, pad_id, "i4")]).tolist()

    def sized(c: str) -> Column:
        return F.sort_array(F.collect_list(F.struct("offset", "length", "doc_id", "start", "ids"))).alias(c)

    return (
        pieces.groupBy("sequence_id")
        .agg(sized("parts"), n.alias("n_tokens"))
        .select("sequence_id", join("parts", "n_tokens").alias("ids"), "n_tokens", F.col("parts").alias("docs"))
    )


__all__ = ["PIECE", "Packer", "pack", "sequences"]
