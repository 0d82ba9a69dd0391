"""Approximate nearest neighbours by multiprobe p-stable hashing.

Every vector is brought to the unit sphere such that a larger inner product with
a query is a smaller distance: vectors are divided by the largest norm and get one
more coordinate that fills them up to length one, queries are divided by their own
norm.  A table hashes a vector to a cell of a randomly shifted grid over a few
random projections (normal, so 2-stable).  Cells are stored once for each table.

A query visits its own cell of each table and then neighbouring cells, those first
into which a near vector is most likely to have fallen: the smaller the squared
distances from the query to the borders that are crossed, the sooner.  How many
cells it visits is fitted: for a bounded sample of queries the true neighbours are
found by a scan of all rows, and so many cells are visited as hold ``fit_recall``
of them.  Where too many would be, the grid is made coarser, down to one cell.

Cells are dealt to shards.  A shard with more vectors than fit one task is split by
rows, whatever cells they stand in, and its queries go to all parts; one with more
queries is split the same way.  Equal vectors are one vector with its first ids,
so that copies neither fill a cell nor multiply candidates.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stage
from .vectors import matrix, numbered, padded

#: Hash tables, the width of a grid's cell in standard deviations of a unit vector's projection, and vectors that a cell should hold.
TABLES, WIDTH, CELL_VECTORS = 4, 2.0, 256
#: Queries of the fitting sample at most, and cells that a query may visit in a table before the grid is made coarser.
FIT_QUERIES, MOST_PROBES = 64, 1024
#: Vectors and queries that meet in one task, and scores that it holds at once.
PART_VECTORS, PART_QUERIES, CELLS = 32768, 4096, 1 << 22
#: Shards whose sizes are broadcast, a few bytes each.
BROADCAST_SHARDS = 200_000
#: Share of a part's vectors below which scores are taken pair by pair instead of as a product of matrices.
FEW = 1 / 16
#: Columns whose maxima bound a query's k-th best score from below.
COLUMNS = 128

HASHED = T.StructType([T.StructField("shard", T.LongType()), T.StructField("cells", T.ArrayType(T.LongType())), T.StructField("id", T.LongType()), T.StructField("first", T.LongType()), T.StructField("vec", T.ArrayType(T.DoubleType()))])
SCORED = T.StructType([T.StructField(n, T.LongType()) for n in ("qid", "id", "first")] + [T.StructField("score", T.DoubleType())])


def boundary_orders(m: int, count: int) -> np.ndarray:
    """Sets of borders to cross, in order of expected success.

    Borders are numbered by their distance from the query, nearest first; of m
    coordinates there are 2m, and numbers j and 2m-1-j are the two sides of one
    coordinate.  Row i marks the borders of set i.  Sets grow from the nearest
    border by exchange of the last border for the next one, or by adding it, with
    a heap on the expected squared distances of m uniform places.
    """
    import heapq

    j = np.arange(1, m + 1)
    near = j * (j + 1) / (4 * (m + 1) * (m + 2))
    k = np.arange(m, 0, -1)
    far = 1 - k / (m + 1) + k * (k + 1) / (4 * (m + 1) * (m + 2))
    cost = np.concatenate([near, far])
    rows: list[tuple] = [()]
    heap = [(cost[0], (0,))]
    while heap and len(rows) < count:
        total, chosen = heapq.heappop(heap)
        if not {2 * m - 1 - c for c in chosen} & set(chosen):
            rows.append(chosen)
        last = chosen[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (total - cost[last] + cost[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (total + cost[last + 1], (*chosen, last + 1)))
    out = np.zeros((len(rows), 2 * m), bool)
    for i, chosen in enumerate(rows):
        out[i, list(chosen)] = True
    return out


class Grid:
    """Hash tables over vectors of a dimension; the same for the same seed on every worker."""

    def __init__(self, dim: int, longest: float, m: int, probes: int = 1, tables: int = TABLES, seed: int = 13):
        self.dim, self.longest, self.m, self.tables = dim, longest, m, tables
        r = np.random.default_rng([seed, m])
        self.lines = r.standard_normal((tables, dim + 1, m)) / WIDTH
        self.shift = r.random((tables, m))
        self.factor = r.integers(-(2**62), 2**62, (tables, m))
        self.start = r.integers(-(2**62), 2**62, tables)
        self.probes = probes
        # more sets than are visited: each query takes its own best of them
        self.sets = boundary_orders(m, 4 * probes) if m else np.zeros((1, 0), bool)

    def sphere(self, x: np.ndarray) -> np.ndarray:
        x = padded(x, self.dim) / self.longest
        return np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1, keepdims=True)))], 1)

    def query_sphere(self, q: np.ndarray) -> np.ndarray:
        q = padded(q, self.dim)
        q = q / np.abs(q).max(1, keepdims=True)
        return np.concatenate([q / np.sqrt((q * q).sum(1, keepdims=True)), np.zeros((len(q), 1))], 1)

    def places(self, unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells as 64-bit numbers, and where in its cell each vector stands."""
        at = unit @ self.lines[table] + self.shift[table]
        cell = np.floor(at)
        return (cell.astype("i8") * self.factor[table]).sum(1) + self.start[table], at - cell

    def visited(self, unit: np.ndarray, table: int) -> np.ndarray:
        """``[query, visit]``: cells in order of estimated success."""
        own, inside = self.places(unit, table)
        if not self.m:
            return own[:, None]
        border = np.concatenate([inside, 1 - inside], 1)  # below, above
        step = np.concatenate([-self.factor[table], self.factor[table]])
        order = np.argsort(border, axis=1, kind="stable")
        sets = self.sets.astype("i8")
        cells = own[:, None] + step[order] @ sets.T
        cost = np.take_along_axis(border, order, 1) ** 2 @ sets.T.astype("f8")
        best = np.argsort(cost, axis=1, kind="stable")[:, : self.probes]
        return np.take_along_axis(cells, best, 1)


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows by rows, summed in order of dimension: the same for equal vectors wherever they stand."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def promising(q: np.ndarray, c: np.ndarray, k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that hold each query's k best, and few others, by single precision scores and their error bound."""
    small = [(x / (np.abs(x).max(initial=0) or 1.0)).astype("f4") for x in (q, c)]
    rough = small[0] @ small[1].T
    if allowed is not None:
        rough = np.where(allowed, rough, np.float32(-math.inf))
    n = rough.shape[1]
    floor = np.full(len(q), -math.inf, "f4")
    if n > 8 * COLUMNS and k <= COLUMNS:
        # the k-th largest of the columns' maxima is not above the k-th best
        tops = rough[:, : n // COLUMNS * COLUMNS].reshape(len(q), -1, COLUMNS).max(1)
        floor = np.partition(tops, COLUMNS - k, axis=1)[:, COLUMNS - k]
    elif n > k:
        floor = np.partition(rough, n - k, axis=1)[:, n - k]
    slack = np.abs(small[0]).sum(1) * np.float32(2.0**-21 * (1 + q.shape[1] / 16))
    keep = rough >= (floor - slack)[:, None]
    if allowed is not None:
        keep &= allowed
    return np.nonzero(keep)


def nearest(q: np.ndarray, c: np.ndarray, first: np.ndarray, k: int, allowed: np.ndarray | None = None):
    """``row of q, row of c, score`` of each query's k best; ties to the smaller ``first``."""
    if allowed is not None and allowed.mean() < FEW:
        i, j = np.nonzero(allowed)
    else:
        i, j = promising(q, c, k, allowed)
    score = np.empty(len(i))
    for a in range(0, len(i), 1 << 16):
        score[a : a + (1 << 16)] = products(q[i[a : a + (1 << 16)]], c[j[a : a + (1 << 16)]])
    order = np.lexsort((first[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return i[best], j[best], score[best]


def exact_sample(distinct: DataFrame, sample: list, k: int) -> DataFrame:
    """``qid, vec, place`` of the true neighbours of a few queries, by a scan of all vectors."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType([*SCORED, T.StructField("vec", T.ArrayType(T.DoubleType()))]))
    qids = np.array([r.uid for r in sample])
    queries = distinct.sparkSession.sparkContext.broadcast([list(r.embedding) for r in sample])

    def run(batches):
        q = matrix(pa.array(queries.value, pa.list_(pa.float64())))
        for batch in batches:
            if not batch.num_rows:
                continue
            c = matrix(batch.column(1))
            width = max(q.shape[1], c.shape[1])
            i, j, score = nearest(padded(q, width), padded(c, width), batch.column(0).to_numpy(), k)
            cols = [pa.array(qids[i]), *[batch.column(0).take(pa.array(j))] * 2, pa.array(score), batch.column(1).take(pa.array(j)).cast(schema.field("vec").type)]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    best = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    kind = T.StructType([*SCORED, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    found = distinct.select("id", "embedding").mapInArrow(run, kind)
    return found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)


def fit(distinct: DataFrame, queries: DataFrame, k: int, recall: float, longest: float, dim: int) -> Grid:
    """A grid, and the visits that find ``recall`` of the sample's true neighbours."""
    n = distinct.count()
    sample = queries.orderBy(F.xxhash64("uid"), "uid").limit(FIT_QUERIES).collect()
    m = max(0, round(math.log(max(1.0, n / CELL_VECTORS)) / math.log(2.2)))
    if not sample or not m:
        return Grid(dim, longest, 0)
    own = {r.uid: list(r.embedding) for r in sample}
    truth = [r for r in exact_sample(distinct, sample, k + 1).select("qid", "vec").collect() if list(r.vec) != own[r.qid]]
    if not truth:
        return Grid(dim, longest, 0)
    q = matrix(pa.array([list(r.embedding) for r in sample], pa.list_(pa.float64())))
    row = {r.uid: i for i, r in enumerate(sample)}
    c = matrix(pa.array([list(r.vec) for r in truth], pa.list_(pa.float64())))
    owner = np.array([row[r.qid] for r in truth])
    while m:
        grid = Grid(dim, longest, m, MOST_PROBES)
        first = np.full(len(truth), MOST_PROBES + 1)
        for t in range(grid.tables):
            cells, _ = grid.places(grid.sphere(c), t)
            seen = grid.visited(grid.query_sphere(q), t)[owner] == cells[:, None]
            first = np.minimum(first, np.where(seen.any(1), seen.argmax(1) + 1, MOST_PROBES + 1))
        need = int(np.sort(first)[min(len(first) - 1, math.ceil(recall * len(first)))])
        if need <= MOST_PROBES:
            return Grid(dim, longest, m, need)
        m -= 1
    return Grid(dim, longest, 0)


def hashed(vectors: DataFrame, grid: Grid, shards: int, query: bool, light: bool = False) -> DataFrame:
    """``shard, cells, id, first, vec``: a row for each shard in which a vector stands or which a query visits; no ``vec`` if ``light``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(HASHED)

    wide = 4 * grid.probes if query else 1

    def cut(batches):
        for batch in batches:
            step = max(1, CELLS // wide)
            for i in range(0, batch.num_rows, step):
                yield batch.slice(i, step)

    def run(batches):
        for batch in cut(batches):
            x = matrix(batch.column(1))
            unit = grid.query_sphere(x) if query else grid.sphere(x)
            cells = [grid.visited(unit, t) if query else grid.places(unit, t)[0][:, None] for t in range(grid.tables)]
            width = sum(c.shape[1] for c in cells)
            cells = np.concatenate(cells, 1).ravel()
            row = np.repeat(np.arange(len(x)), width)
            shard = (cells ^ cells >> 32) % shards
            order = np.lexsort((cells, shard, row))
            row, shard, cells = row[order], shard[order], cells[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (shard[1:] != shard[:-1])
            at = np.flatnonzero(new)
            edges = np.append(at, len(row)).astype("i4")
            for a in range(0, len(at), 20_000):
                b = min(a + 20_000, len(at))
                own = pa.array(row[at[a:b]])
                lists = pa.ListArray.from_arrays(pa.array(edges[a : b + 1] - edges[a], pa.int32()), pa.array(cells[edges[a] : edges[b]]))
                vec = pa.nulls(len(own), schema.field("vec").type) if light else batch.column(1).take(own)
                cols = [pa.array(shard[at[a:b]]), lists, batch.column(0).take(own), batch.column(2).take(own), vec]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return vectors.select("id", "embedding", "first").mapInArrow(run, HASHED)


def matched(k: int):
    """Of one part of a shard: each query's k best among the vectors of the cells that it visits."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(SCORED)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0, "i8")], [np.zeros(0)]]
        if left.num_rows and right.num_rows:
            q, c = matrix(left["vec"].combine_chunks()), matrix(right["vec"].combine_chunks())
            width = max(q.shape[1], c.shape[1])
            q, c = padded(q, width), padded(c, width)
            qids, ids = left["id"].to_numpy(), right["id"].to_numpy()
            first = right["first"].to_numpy()
            visits, stands = left["cells"].combine_chunks(), right["cells"].combine_chunks()
            names, stand = np.unique(stands.flatten().to_numpy(), return_inverse=True)
            begins = np.cumsum(stands.value_lengths().to_numpy()) - stands.value_lengths().to_numpy()
            step = max(1, CELLS // len(c))
            for a in range(0, len(q), step):
                part = visits.slice(a, step)
                n = len(part)
                cell = part.flatten().to_numpy()
                at = np.searchsorted(names, cell)
                known = names[np.minimum(at, len(names) - 1)] == cell
                goes = np.zeros((n, len(names)), bool)
                goes[np.repeat(np.arange(n), part.value_lengths().to_numpy())[known], at[known]] = True
                allowed = goes[:, stand]
                if len(stand) > len(c):  # a vector stands in cells of several tables here
                    allowed = np.logical_or.reduceat(allowed, begins, axis=1)
                asked = allowed.any(1)
                i, j, score = nearest(q[a : a + step][asked], c, first, k, allowed[asked])
                for column, found in zip(out, (qids[a : a + step][asked][i], ids[j], first[j], score), strict=True):
                    column.append(found)
        return pa.Table.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return run


def split(side: DataFrame, parts: str, copies: str, sizes: DataFrame, n: int) -> DataFrame:
    """Rows of one side: its own part by a hash of the id, and a copy for each part of the other side."""
    known = side.join(F.broadcast(sizes) if n <= BROADCAST_SHARDS else sizes, "shard")
    own = F.pmod(F.xxhash64("id"), F.col(parts)).alias(parts)
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(copies) - 1)).alias(copies)
    return known.select("shard", "cells", "id", "first", "vec", own, other)


def search(vectors: DataFrame, query: str, k: int = 20, recall: float = 0.97) -> DataFrame:
    """The k rows with the largest inner product found for each row that ``query``, a condition on ``vec_id``, selects.

    ``vectors(vec_id, embedding)``.  Null vectors, those with a component that is
    null or not finite, and zero vectors take no part; shorter ones count as
    filled up with zeros.  Candidates are all rows but the query's own: rows that
    repeat an id or a vector are rows of their own.  A row with a null id is no
    query, comes last among ties and is given as null.  Other columns are
    ignored; no rows give no rows, and a query without other rows gives none.
    ``recall`` is what the fitting sample has to reach, a little more than is
    wanted of all queries.
    """
    rows = numbered(vectors.filter(F.exists(F.col("embedding").cast("array<double>"), lambda x: x != 0.0)))
    spark = rows.sparkSession
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    found = rows.agg(F.max(length).alias("longest"), F.max(F.size("embedding")).alias("dim")).first()
    longest, dim = float(found.longest or 1.0), int(found.dim or 1)

    # Of equal vectors the first k + 1 ids are enough: no other can be among a query's k first, without its own row.
    # The hash comes first: sorting by it compares few vectors.
    first = Window.partitionBy(F.xxhash64("embedding"), "embedding").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    ranked = rows.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= k + 1)
    member = F.struct("place", "vec_id", "uid")
    distinct = ranked.groupBy(F.xxhash64("embedding"), "embedding").agg(F.sort_array(F.collect_list(member)).alias("members"))
    distinct = distinct.select(F.col("members")[0]["vec_id"].alias("first_id"), F.col("members")[0]["uid"].alias("uid"), "embedding", "members")
    distinct = stage(distinct, "distinct-vectors")
    asking = rows.filter(query)
    queries = stage(asking.groupBy("embedding").agg(F.min("uid").alias("uid")), "query-vectors")
    last = F.lit((1 << 63) - 1)
    points = distinct.select(F.col("uid").alias("id"), "embedding", F.coalesce("first_id", last).alias("first"))
    asked = queries.select(F.col("uid").alias("id"), "embedding", F.lit(0).cast("long").alias("first"))

    grid = fit(points, queries, k, recall, longest, dim)
    n = points.count()
    shards = max(1, n * grid.tables // PART_VECTORS)
    bounded_batches(spark)
    stands = hashed(points, grid, shards, False)
    visits = stage(hashed(asked, grid, shards, True), "visits")
    parts = lambda size, name: F.greatest(F.lit(1), F.ceil(F.count("*") / size)).cast("long").alias(name)
    sizes = hashed(points, grid, shards, False, light=True).groupBy("shard").agg(parts(PART_VECTORS, "parts")).join(visits.groupBy("shard").agg(parts(PART_QUERIES, "copies")), "shard")
    sizes = stage(sizes, "shard-sizes")
    n_sizes = sizes.count()
    left = split(visits, "copies", "parts", sizes, n_sizes).groupBy("shard", "parts", "copies")
    right = split(stands, "parts", "copies", sizes, n_sizes).groupBy("shard", "parts", "copies")
    near = left.cogroup(right).applyInArrow(matched(k + 1), SCORED)

    # candidates of several tables merged, then rows for vectors
    near = near.groupBy("qid", "id").agg(F.max("score").alias("score"), F.first("first").alias("first"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "first", "id")
    near = stage(near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1).select("qid", "id", "score"), "near-vectors")
    near = near.join(distinct.select(F.col("uid").alias("id"), "members"), "id").select("qid", "score", F.explode("members").alias("m"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), F.col("m.vec_id").asc_nulls_last(), "m.uid")
    near = near.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    lists = near.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("place", "m", "score"))).alias("found"))
    lists = lists.join(queries.select(F.col("uid").alias("qid"), "embedding"), "qid").select("embedding", "found")

    own = asking.join(lists, "embedding")
    others = F.slice(F.filter("found", lambda x: x["m"]["uid"] != F.col("uid")), 1, k)
    out = own.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("place", "x"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("x.m.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
