"""Hard negatives by Four-Russians scoring.

Components become integers.  A candidate's integers are cut into bit planes (two's
complement), and eight dimensions of a plane into one byte.  An anchor has a table
for each eight dimensions: for each byte the sum of the anchor's components whose
bit is set.  A score is then, plane by plane, the sum of one look-up for every
eight dimensions, shifted by the plane and added up, the top plane with a minus.
It is the exact inner product of the whole vectors.

Anchors and candidates meet in blocks of bounded size: a candidate goes to each
block of anchors once and an anchor to each block of candidates.  Of a block's
scores only an anchor's first few rows leave a task.  What positives an anchor has
depends on all rows, so candidates of the anchor's label are scored first, and
those of other labels in a second pass that knows the positives' scores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stage
from .vectors import matrix, numbered

#: Anchors and candidates of a block; the fewer blocks, the fewer copies of rows.
ANCHORS = 1024
CANDIDATES = (4096, 32768)
#: Scores held at once.
CELLS = 1 << 22
#: Each component is at most this times a power of two: scores of 64 bits hold what is below.
SAFE = 1 << 62
SCALE = 256

PACKED = T.StructType(
    [
        T.StructField("uid", T.LongType()),
        T.StructField("vec_id", T.LongType()),
        T.StructField("label", T.LongType()),
        T.StructField("planes", T.IntegerType()),
        T.StructField("bits", T.BinaryType()),
    ]
)
POSITIVES = T.StructType([T.StructField(n, T.LongType()) for n in ("auid", "anchor_id", "uid", "positive_id", "score")])
NEGATIVES = T.StructType([T.StructField(n, T.LongType()) for n in ("auid", "place", "uid", "negative_id", "score")])


def integers(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as Python integers where 64 bits are too few."""
    y = np.floor(x * SCALE)
    if np.abs(y).max(initial=0) < SAFE:
        return y.astype("i8")
    return np.array([[int(np.floor(v)) * SCALE if abs(v) >= 2**53 else int(np.floor(v * SCALE)) for v in row] for row in x.tolist()], object).reshape(x.shape)


def plane_count(values: np.ndarray) -> int:
    """Bits of two's complement that hold all values."""
    top = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    return int(top).bit_length() + 1


def plane_bytes(values: np.ndarray, planes: int) -> np.ndarray:
    """``[row, plane, eight dimensions]``: bit d of a byte is the plane's bit of dimension d."""
    n, d = values.shape
    groups = -(-d // 8)
    wide = np.zeros((n, groups * 8), values.dtype)
    wide[:, :d] = values
    out = np.empty((n, planes, groups), "u1")
    for b in range(planes):
        out[:, b] = np.packbits((wide >> b & 1).astype(bool), axis=1, bitorder="little")
    return out


def values_of(planes: np.ndarray) -> np.ndarray:
    """The integers of packed planes."""
    n, p, groups = planes.shape
    out = np.zeros((n, groups * 8), "i8" if p < 63 else object)
    for b in range(p):
        bits = np.unpackbits(planes[:, b], axis=1, bitorder="little").astype(out.dtype)
        out += -(bits << b) if b == p - 1 else bits << b
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``[eight dimensions, byte, anchor]``: the sum of the components whose bit is set."""
    n, d = anchors.shape
    groups = d // 8
    tables = np.zeros((groups, 256, n), anchors.dtype)
    by_group = anchors.reshape(n, groups, 8).transpose(1, 2, 0)
    for bit in range(8):
        tables[:, 1 << bit : 2 << bit] = tables[:, : 1 << bit] + by_group[:, bit, None]
    return tables


def scores(tables: np.ndarray, planes: np.ndarray, dtype) -> np.ndarray:
    """``[candidate, anchor]``: look-ups summed by plane, then shifted and added."""
    n, p, groups = planes.shape
    groups = min(groups, len(tables))  # what one side lacks is zero
    out = np.zeros((n, tables.shape[2]), dtype)
    for b in range(p):
        plane = np.zeros_like(out)
        for g in range(groups):
            plane += tables[g][planes[:, b, g]]
        plane <<= b
        out += -plane if b == p - 1 else plane
    return out


def score_type(anchors: np.ndarray, planes: np.ndarray):
    """The narrowest type that holds every score and partial sum."""
    most = int(abs(anchors).max(initial=0)) * max(1, anchors.shape[1]) << planes.shape[1]
    return np.int32 if most < 1 << 31 else np.int64 if most < SAFE else object


class Block:
    """Rows of one side as arrays, by ``order``."""

    def __init__(self, table: pa.Table):
        self.uid, self.label = table["uid"].to_numpy(), table["label"].to_numpy()
        ids = table["vec_id"].combine_chunks()
        self.null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        self.id = ids.fill_null(0).to_numpy()
        planes = table["planes"].to_numpy()
        raw = table["bits"].to_pylist()
        most, groups = int(planes.max()), max(len(r) // p for r, p in zip(raw, planes.tolist(), strict=True))
        self.planes = np.zeros((len(raw), most, groups), "u1")
        for p in np.unique(planes).tolist():
            for g in {len(raw[i]) // p for i in np.flatnonzero(planes == p).tolist()}:
                rows = np.array([i for i in np.flatnonzero(planes == p).tolist() if len(raw[i]) == p * g])
                own = np.frombuffer(b"".join(raw[i] for i in rows), "u1").reshape(len(rows), p, g)
                self.planes[rows, :p, :g] = own
                self.planes[rows, p:, :g] = own[:, p - 1 :]  # the sign goes on

    def order(self, by_label: bool) -> None:
        """Ascending by vec_id, null last, within labels if asked."""
        at = np.lexsort((self.uid, self.id, self.null, self.label) if by_label else (self.uid, self.id, self.null))
        for name in ("uid", "label", "id", "null", "planes"):
            setattr(self, name, getattr(self, name)[at])

    def ids(self, at) -> list:
        return [None if n else i for i, n in zip(self.id[at].tolist(), self.null[at].tolist(), strict=True)]


def pack(rows: DataFrame) -> DataFrame:
    """``uid, vec_id, label, planes, bits`` of numbered rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(PACKED)

    def run(batches):
        for batch in batches:
            values = integers(matrix(batch.column(3))) if batch.num_rows else np.zeros((0, 0), "i8")
            planes = plane_count(values)
            bits = plane_bytes(values, planes)
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array([planes] * batch.num_rows, pa.int32()), pa.array([b.tobytes() for b in bits], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return rows.select("uid", "vec_id", "label", "embedding").mapInArrow(run, PACKED)


def dealt(left: DataFrame, right: DataFrame, n_left: int, n_right: int):
    """Both sides grouped by (block of anchors, block of candidates)."""
    a = max(1, -(-n_left // ANCHORS))
    wide = min(max(n_right // 48, CANDIDATES[0]), CANDIDATES[1])
    c = max(1, -(-n_right // wide))

    def own(n: int):
        return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")

    anchors = left.toDF(*left.columns).withColumn("a", own(a)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(c - 1))))
    candidates = right.withColumn("c", own(c)).withColumn("a", F.explode(F.sequence(F.lit(0), F.lit(a - 1))))
    return anchors.groupBy("a", "c").cogroup(candidates.groupBy("a", "c"))


def first_of(values: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k largest of each row, largest first and ties by index."""
    n = values.shape[1]
    if values.dtype == object:
        return np.array([sorted(range(n), key=lambda i: (-row[i], i))[:k] for row in values.tolist()])
    key = values.astype("i8") * n + np.arange(n - 1, -1, -1)
    if n > k:
        key = np.partition(key, n - k, axis=1)[:, n - k :]
    return n - 1 - np.sort(key, axis=1)[:, ::-1] % n


def keyed_safe(dtype, most: int, n: int):
    """Python integers where score times rows would not fit 64 bits."""
    return object if dtype is object or most * n >= SAFE else dtype


def within(score: int) -> int:
    return max(-(1 << 63), min(score, (1 << 63) - 1))


def nearest_positives(k: int):
    """Of a block, each anchor's first ``k`` candidates of its own label."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(POSITIVES)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in schema]
        if left.num_rows and right.num_rows:
            anchors, rows = Block(left), Block(right)
            anchors.order(True)
            rows.order(True)
            values = values_of(anchors.planes)
            kind = score_type(values, rows.planes)
            most = int(abs(values).max(initial=0)) * max(1, values.shape[1]) << rows.planes.shape[1]
            for label in np.unique(anchors.label).tolist():
                a = np.flatnonzero(anchors.label == label)
                b = np.flatnonzero(rows.label == label)
                if not len(b):
                    continue
                dtype = keyed_safe(kind, most, len(b))
                step = max(1, CELLS // len(b))
                for i in range(0, len(a), step):
                    part = a[i : i + step]
                    found = scores(subset_sums(values[part].astype(dtype)), rows.planes[b], dtype).T
                    best = first_of(found, k + 1)
                    for x, at in zip(part.tolist(), range(len(part)), strict=True):
                        keep = [j for j in best[at].tolist() if rows.uid[b[j]] != anchors.uid[x]][:k]
                        where = b[keep]
                        out[0] += [int(anchors.uid[x])] * len(keep)
                        out[1] += [int(anchors.id[x])] * len(keep)
                        out[2] += rows.uid[where].tolist()
                        out[3] += rows.ids(where)
                        out[4] += [within(int(found[at, j])) for j in keep]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def hardest_negatives(k: int, low: int, high: int):
    """Of a block, for each positive of each anchor the first ``k`` rows of other labels between ``low`` and ``high`` hundredths of its score."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(NEGATIVES)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in schema]
        if left.num_rows and right.num_rows:
            anchors, rows = Block(left), Block(right)
            goals = dict(zip(left["uid"].to_pylist(), left["goals"].to_pylist(), strict=True))
            rows.order(False)
            values = values_of(anchors.planes)
            most = int(abs(values).max(initial=0)) * max(1, values.shape[1]) << rows.planes.shape[1]
            n = len(rows.uid)
            dtype = keyed_safe(score_type(values, rows.planes), most, n)
            step = max(1, CELLS // n)
            tie = np.arange(n - 1, -1, -1)
            for i in range(0, len(anchors.uid), step):
                part = slice(i, i + step)
                found = scores(subset_sums(values[part].astype(dtype)), rows.planes, dtype).T
                key = found.astype("i8" if dtype is not object else object) * n + tie  # by score, then by the smaller vec_id
                for x, own in enumerate(key):
                    uid, label = int(anchors.uid[i + x]), anchors.label[i + x]
                    own = np.sort(own[rows.label != label])
                    for place, score in enumerate(goals[uid]):
                        # 100 s between low * score and high * score
                        least, past = -(-low * score // 100), min(high * score // 100, most) + 1
                        to = int(np.searchsorted(own, past * n))
                        keys = [v for v in own[max(0, to - k) : to][::-1].tolist() if v >= least * n]
                        where = np.array([n - 1 - v % n for v in keys], int)
                        out[0] += [uid] * len(keys)
                        out[1] += [place] * len(keys)
                        out[2] += rows.uid[where].tolist()
                        out[3] += rows.ids(where)
                        out[4] += [within(v // n) for v in keys]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return run


def mine(vectors: DataFrame, anchor: str, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """Negatives that score between ``low`` and ``high`` percent of a positive, hardest first.

    ``vectors(vec_id, label, embedding)``; ``anchor`` is an SQL condition on
    ``vec_id``.  Rows with a null label, a null vector or a component that is
    null or not finite take no part; shorter vectors count as filled up with
    zeros.  Every row is one of its own: rows that repeat an id are each other's
    positives, and an anchor that stands twice is answered twice.  A row with a
    null id is no anchor, comes last among ties and is given as null.  Other
    columns are ignored; no rows give no rows.  A score beyond 64 bits counts as
    the largest or smallest number of 64 bits.
    """
    rows = numbered(vectors.filter(F.col("label").isNotNull()), F.col("label").cast("long").alias("label"))
    bounded_batches(vectors.sparkSession)
    packed = stage(pack(rows), "packed-planes")
    anchors = packed.filter(anchor)
    n_anchors, n_rows = anchors.count(), packed.count()

    by = Window.partitionBy("auid").orderBy(F.desc("score"), F.col("positive_id").asc_nulls_last(), "uid")
    found = dealt(anchors, packed, n_anchors, n_rows).applyInArrow(nearest_positives(positives), POSITIVES)
    found = found.withColumn("place", F.row_number().over(by) - 1).filter(F.col("place") < positives)
    found = stage(found, "positives")

    goals = found.groupBy("auid").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).getField("score").alias("goals"))
    with_goals = anchors.join(goals.withColumnRenamed("auid", "uid"), "uid")
    hard = dealt(with_goals, packed, n_anchors, n_rows).applyInArrow(hardest_negatives(negatives, low, high), NEGATIVES)
    by = Window.partitionBy("auid", "place").orderBy(F.desc("score"), F.col("negative_id").asc_nulls_last(), "uid")
    hard = hard.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= negatives)
    hard = hard.select("auid", "place", "rank", "negative_id", F.col("score").alias("negative_score"))
    out = found.join(hard, ["auid", "place"])
    return out.select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")
