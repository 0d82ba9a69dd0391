"""Near-duplicate groups by b-bit MinHash.

A document's set is its distinct w-word shingles.  From the set come the minima
of ``bands * rows`` permutations; the minima of a band name a bucket, and the
low ``bits`` of all minima, packed, are the signature.  Documents with equal
sets form a class of which the smallest doc_id goes on.  Then:

1. Of the smallest documents of the buckets that a document lies in, that with
   which it shares most buckets is its candidate.  The signatures' estimate
   sorts out chance meetings, the texts confirm; confirmed candidates give each
   document one parent, and trees of these give labels.
2. Of the other buckets' smallest documents that still have another label, the
   likeliest few are confirmed too.
3. In buckets that still hold several labels, the documents outside the largest
   label are compared with all, in blocks of bounded size.  Documents of the
   largest label are never compared with each other.  Where the signatures allow
   a link and none joins the two labels yet, the texts decide, in the task, so
   that only links come out: fewer than the labels of a block.

So no link between different labels is lost, while pairs of documents are never
made as rows.  Documents that share no bucket are missed: with the default 32
bands of 5, three in a million at a similarity of 0.8.  The estimate rules out
what lies ``margin`` deviations below it.

All steps are joins and groupings of Spark, and each table that is used again
is written to the shared folder.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches, stage

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SKETCH = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_shingles", T.LongType()),
        T.StructField("set_key", T.BinaryType()),
        T.StructField("sig", T.ArrayType(T.LongType(), False)),
        T.StructField("buckets", T.ArrayType(T.LongType(), False)),
    ]
)
#: Ids that may be sent to every executor: 2 million are some 40 MB there.
BROADCAST_IDS = 2_000_000


def words(text: str) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case."""
    return text.encode().translate(LOWER).split()


def shingle_set(text: str | None, width: int) -> set:
    """Distinct shingles; a shorter text is one shingle, one without words has none."""
    w = words(text or "")
    if not w:
        return set()
    if len(w) < width:
        return {tuple(w)}
    return set(zip(*(w[i:] for i in range(width)), strict=False))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (multiply and xor-shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sketcher:
    """Hashes the words of many texts at once, then each text's set."""

    def __init__(self, width: int, bands: int, rows: int, bits: int, seed: int = 7):
        self.width, self.bands, self.rows, self.bits = width, bands, rows, bits
        r = np.random.default_rng(seed)
        k = bands * rows
        self.a = r.integers(0, 1 << 32, k, "u4") | np.uint32(1)
        self.b = r.integers(0, 1 << 32, k, "u4")
        self.base = np.uint64(0x9E3779B97F4A7C15)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.weights = r.integers(1, 1 << 63, rows, "u8") | np.uint64(1)
        self.salts = mix(np.arange(1, bands + 1, dtype="u8"))
        self.powers = self.inverses = np.ones(1, "u8")

    def shingles(self, texts: list) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes for each text."""
        raw = [(t or "").encode() for t in texts]
        data = np.frombuffer(b" ".join([*raw, b""]).translate(LOWER), "u1")
        n = len(data)
        if len(self.powers) < n + 1:
            size = 1 << (n + 1).bit_length()
            self.powers = np.multiply.accumulate(np.full(size, self.base, "u8"))
            self.inverses = np.multiply.accumulate(np.full(size, self.inverse, "u8"))
        word = (data != 32) & ((data < 9) | (data > 13))
        edge = np.diff(np.concatenate([[False], word, [False]]).astype("i1"))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.zeros(n + 1, "u8")
        np.cumsum((data.astype("u8") + np.uint64(1)) * self.powers[:n], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * self.inverses[starts])
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
        grams = h.copy()
        for i in range(1, self.width):
            grams[: len(h) - i] = mix(grams[: len(h) - i] * np.uint64(0xD6E8FEB86659FD93) + h[i:])
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if hi - lo >= self.width:
                out.append(np.unique(grams[lo : hi - self.width + 1]))
            elif hi > lo:
                x = np.full(1, hi - lo, "u8")
                for i in range(lo, hi):
                    x = mix(x * np.uint64(31) + h[i : i + 1])
                out.append(x)
            else:
                out.append(h[:0])
        return out

    def minima(self, grams: np.ndarray) -> np.ndarray:
        x = (grams >> np.uint64(32)).astype("u4")
        least = None
        for at in range(0, len(x), 2048):
            m = np.multiply.outer(self.a, x[at : at + 2048])
            m += self.b[:, None]
            m = m.min(axis=1)
            least = m if least is None else np.minimum(least, m)
        return least

    def sketch(self, texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("n_shingles", "set_key", "sig", "buckets")}
        per = 64 // self.bits
        for grams in self.shingles(texts):
            out["n_shingles"].append(len(grams))
            if not len(grams):
                for n in ("set_key", "sig", "buckets"):
                    out[n].append(None)
                continue
            least = self.minima(grams).astype("u8")
            out["set_key"].append(hashlib.blake2b(grams.tobytes(), digest_size=16).digest())
            low = np.zeros(-(-len(least) // per) * per, "u8")
            low[: len(least)] = least & np.uint64((1 << self.bits) - 1)
            shifts = np.arange(per, dtype="u8") * np.uint64(self.bits)
            out["sig"].append(np.bitwise_or.reduce(low.reshape(-1, per) << shifts, axis=1).view("i8"))
            keys = (mix(least).reshape(self.bands, self.rows) * self.weights).sum(axis=1, dtype="u8")
            out["buckets"].append(mix(keys + self.salts).view("i8"))
        return out


def sketches(docs: DataFrame, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    def run(part, sketcher):
        return {"doc_id": part["doc_id"], **sketcher.sketch(part["text"])}

    cols = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(cols, run, SKETCH, setup=lambda: Sketcher(width, bands, rows, bits))


def estimate(bits: int, k: int, a: str, b: str) -> Column:
    """Similarity from two packed signatures, chance agreement of b bits taken out."""
    ones = sum(1 << (i * bits) for i in range(64 // bits))
    mask = ones - (1 << 64) if ones >> 63 else ones

    def differing(x: Column, y: Column) -> Column:
        z = x.bitwiseXOR(y)
        fold = z
        for i in range(1, bits):
            fold = fold.bitwiseOR(F.shiftrightunsigned(z, i))
        return F.bit_count(fold.bitwiseAND(F.lit(mask)))

    diff = F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, x: s + x)
    chance = 2.0**-bits
    return ((1 - diff / F.lit(float(k))) - F.lit(chance)) / F.lit(1 - chance)


#: Roles of documents in pairs that may be sent to every executor (some 60 bytes each).
BROADCAST_ROLES = 500_000
#: Documents that are held against one copy of another's text.
CHUNK = 64


def texts_of(docs: DataFrame, ids: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``ids(doc, ...)`` with the texts of the documents; a few ids go to the texts, many meet them by a shuffle."""
    side = F.broadcast(ids) if ids.count() <= most else ids
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).join(side, "doc")


def confirm(docs: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose full sets have 100 * intersection >= percent * union.

    The text of ``a`` stands once for each ``CHUNK`` of its partners, not once
    for each partner, and a much asked ``a`` is dealt over many tasks.
    """
    asked = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = pairs.join(asked, "a").select("a", "b", F.pmod(F.xxhash64("b"), "chunks").alias("chunk"))
    dealt = stage(dealt, "dup-dealt")
    roles = dealt.select(F.col("b").alias("doc"), "a", "chunk", F.lit(True).alias("partner")).union(dealt.select("a", "a", "chunk", F.lit(False)).distinct())
    roles = stage(roles, "dup-roles")
    rows = texts_of(docs, roles, BROADCAST_ROLES).select("a", "chunk", "partner", "doc", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "partner")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])

    def run(batches):
        held, own = None, []
        for batch in batches:
            out: dict[str, list] = {"a": [], "b": []}
            a, chunk, partner, doc, text = batch.columns
            for i in range(batch.num_rows):
                key = (a[i].as_py(), chunk[i].as_py())
                other = shingle_set(text[i].as_py(), width)
                if not partner[i].as_py():  # rows that share a doc_id are one document with the links of all
                    own = [*own, other] if key == held else [other]
                    held = key
                elif any(alike(x, other, percent) for x in own):
                    out["a"].append(key[0])
                    out["b"].append(doc[i].as_py())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return rows.mapInArrow(run, schema)


def alike(x: set, y: set, percent: int) -> bool:
    common = len(x & y)
    return common > 0 and 100 * common >= percent * (len(x) + len(y) - common)


def jump(labels: DataFrame) -> DataFrame:
    """Follow ``doc -> label`` to the roots, doubling the steps each time."""
    while True:
        up = labels.select(F.col("doc").alias("label"), F.col("label").alias("above"))
        new = labels.join(up, "label", "left").select("doc", F.coalesce("above", "label").alias("label"), (F.col("above").isNotNull()).alias("moved"))
        new = stage(new, "dup-labels")
        labels = new.select("doc", "label")
        if new.filter("moved").isEmpty():
            return labels


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node for each node of the edges ``(a, b)``.

    Each round takes the least label among neighbours and follows it to its
    root; rounds end when no edge joins two labels.
    """
    edges = stage(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "dup-edges")
    nodes = edges.select(F.col("a").alias("doc")).union(edges.select("b")).distinct()
    found = stage(nodes.select("doc", F.col("doc").alias("label")), "dup-labels")
    while not edges.isEmpty():
        # least neighbour of each root; it is smaller, so following it ends
        steps = stage(edges.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("label")), "dup-steps")
        roots = jump(steps)
        found = stage(
            found.join(roots.select(F.col("doc").alias("label"), F.col("label").alias("root")), "label", "left").select("doc", F.coalesce("root", "label").alias("label")),
            "dup-labels",
        )
        a = roots.select(F.col("doc").alias("a"), F.col("label").alias("ra"))
        b = roots.select(F.col("doc").alias("b"), F.col("label").alias("rb"))
        moved = edges.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y"))
        edges = stage(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "dup-edges")
    return found


def by_group(batches, names: tuple[str, ...]):
    """Consecutive rows with equal values of ``names``, each group as a table."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        if not held.num_rows:
            continue
        keys = np.stack([held.column(n).to_numpy() for n in names])
        edges = (np.flatnonzero((np.diff(keys, axis=1) != 0).any(axis=0)) + 1).tolist()
        for start, stop in zip([0, *edges], edges, strict=False):
            yield held.slice(start, stop - start)
        held = held.slice(edges[-1]) if edges else held
    if held is not None and held.num_rows:
        yield held


def signatures(table: pa.Table, name: str = "sig") -> np.ndarray:
    flat = table.column(name).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).view("u8").reshape(table.num_rows, -1)


def differing(x: np.ndarray, y: np.ndarray, bits: int) -> np.ndarray:
    """In how many minima each signature of x differs from each of y."""
    ones = np.uint64(sum(1 << (i * bits) for i in range(64 // bits)))
    z = x[:, None, :] ^ y[None, :, :]
    fold = z.copy()
    for n in range(1, bits):
        fold |= z >> np.uint64(n)
    return np.bitwise_count(fold & ones).sum(axis=2, dtype="i4")


LABEL_PAIR = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def root(up: dict[int, int], x: int) -> int:
    while up.get(x, x) != x:
        up[x] = up.get(up[x], up[x])
        x = up[x]
    return x


def label_links(rows: DataFrame, width: int, bits: int, most: float, percent: int, asked: int) -> DataFrame:
    """Pairs ``a, b`` of labels with a confirmed link.

    ``rows(bucket, i, j, asks, doc, label, sig, buckets, text)`` stand together by
    (bucket, i, j), a bounded number for each; those that ask are held against
    the others, likeliest first, where the signatures differ in ``most`` minima or
    fewer, no link joins their labels yet, and no earlier bucket holds both.  So a
    group hands on fewer links than it has labels, and no pair is tried in two buckets.
    """

    def run(batches):
        sketcher = Sketcher(width, 1, 1, bits)
        for t in by_group(batches, ("bucket", "i", "j")):
            asks, label, sig, text = t.column("asks").to_numpy(), t.column("label").to_numpy(), signatures(t), t.column("text")
            bucket, held = t.column("bucket")[0].as_py(), signatures(t, "buckets").view("i8")
            one, two = np.flatnonzero(asks), np.flatnonzero(~asks)
            grams: dict[int, np.ndarray] = {}
            up: dict[int, int] = {}
            links: list[tuple[int, int]] = []

            def hashed(i, grams=grams, text=text):
                if i not in grams:
                    grams[i] = sketcher.shingles([text[i].as_py()])[0]
                return grams[i]

            for at in range(0, len(one), asked):
                part = one[at : at + asked]
                diff = differing(sig[part], sig[two], bits)
                u, v = np.nonzero((diff <= most) & (label[part][:, None] != label[two][None, :]))
                p, q = part[u], two[v]
                same = held[p] == held[q]
                first = held[p, same.argmax(1)] == bucket if len(p) else np.zeros(0, bool)
                order = np.argsort(diff[u, v][first], kind="stable")
                for x, y in zip(p[first][order].tolist(), q[first][order].tolist(), strict=True):
                    a, b = root(up, int(label[x])), root(up, int(label[y]))
                    if a == b:
                        continue
                    g, h = hashed(x), hashed(y)
                    if 100 * min(len(g), len(h)) < percent * max(len(g), len(h)):
                        continue
                    both = np.sort(np.concatenate([g, h]))
                    common = int((both[1:] == both[:-1]).sum())
                    if 100 * common < percent * (len(g) + len(h) - common):
                        continue
                    if alike(shingle_set(text[x].as_py(), width), shingle_set(text[y].as_py(), width), percent):
                        up[max(a, b)] = min(a, b)
                        links.append((min(a, b), max(a, b)))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], names=LABEL_PAIR.names)

    return rows.mapInArrow(run, LABEL_PAIR).distinct()


def compared(docs: DataFrame, labelled: DataFrame, sk: DataFrame, block: int) -> DataFrame:
    """Rows of ``label_links`` for the buckets of ``labelled(bucket, doc, label)`` that hold several labels.

    In each bucket the documents outside its largest label ask all of it, in
    blocks of both: a document stands once for each block of the other side.
    """
    sizes = labelled.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("bucket").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.max(F.struct("n", (-F.col("label")).alias("l"))).alias("top"))
    rest = F.col("n") - F.col("top.n")
    mixed = whole.filter("labels > 1").select("bucket", (-F.col("top.l")).alias("largest"), F.ceil(rest / block).alias("askers"), F.ceil(F.col("n") / block).alias("blocks"))
    d = stage(labelled.join(stage(mixed, "dup-mixed"), "bucket"), "dup-several")
    place = F.xxhash64("doc")

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    asking = d.filter("label <> largest").select("bucket", F.pmod(place, "askers").alias("i"), every("blocks").alias("j"), F.lit(True).alias("asks"), "doc", "label")
    asked = d.select("bucket", every("askers").alias("i"), F.pmod(place, "blocks").alias("j"), F.lit(False).alias("asks"), "doc", "label")
    texts = stage(texts_of(docs, d.select("doc").distinct()), "dup-texts")
    rows = asking.unionByName(asked).join(sk.select(F.col("doc_id").alias("doc"), "sig", "buckets"), "doc").join(texts, "doc")
    return rows.select("bucket", "i", "j", "asks", "doc", "label", "sig", "buckets", "text").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels(doc, label)`` after the labels of ``links(a, b)`` have become one."""
    roots = components(links).select(F.col("doc").alias("label"), F.col("label").alias("root"))
    grown = labels.join(roots, "label", "left").select("doc", F.coalesce("root", "label").alias("label"))
    fresh = roots.filter("label <> root").select(F.col("label").alias("doc"), F.col("root").alias("label"))
    return stage(grown.union(fresh.join(labels.select("doc"), "doc", "left_anti")), "dup-labels")


def named(rows: DataFrame, labels: DataFrame, doc: str, name: str) -> DataFrame:
    """Rows with the label of their column ``doc``; a document without one is its own."""
    own = labels.select(F.col("doc").alias(doc), F.col("label").alias("_label"))
    return rows.join(own, doc, "left").withColumn(name, F.coalesce("_label", doc)).drop("_label")


def linked(docs: DataFrame, labels: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """Labels after the documents ``pairs(a, b)`` were held against each other."""
    pairs = stage(pairs, "dup-pairs")
    if pairs.isEmpty():
        return labels
    ends = named(named(confirm(docs, pairs, width, percent), labels, "a", "la"), labels, "b", "lb")
    links = stage(ends.filter("la <> lb").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b")).distinct(), "dup-links")
    return labels if links.isEmpty() else joined(labels, links)


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    bands: int = 32,
    rows: int = 5,
    bits: int = 4,
    margin: float = 5.0,
    block: int = 256,
    asked: int = 128,
    hubs_asked: int = 4,
) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id that links reach.  Null or wordless
    texts have no shingles and no links; a null doc_id has a null component and
    is kept.  Rows with one doc_id are one document with the links of all, and
    get a row each.  Other columns are ignored.
    """
    k = bands * rows
    s = percent / 100
    chance = 2.0**-bits
    agree = s + (1 - s) * chance
    most = k * (1 - agree) + margin * math.sqrt(agree * (1 - agree) * k)
    least = s - margin * math.sqrt(agree * (1 - agree) / k) / (1 - chance)
    sk = stage(sketches(docs, width, bands, rows, bits), "dup-sketch")
    real = sk.filter("set_key is not null and doc_id is not null")
    classes = stage(real.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "dup-classes")
    reps = real.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    entries = reps.select(F.col("doc_id").alias("doc"), F.explode("buckets").alias("bucket"))
    hubs = stage(entries.groupBy("bucket").agg(F.min("doc").alias("hub"), F.max("doc").alias("last"), F.count("*").alias("n")).filter("hub <> last").drop("last"), "dup-hubs")
    members = stage(entries.join(hubs, "bucket").select("bucket", "doc", "hub", "n"), "dup-members")

    best = (
        members.filter("doc <> hub")
        .groupBy("doc", "hub")
        .agg(F.count("*").alias("shared"))
        .groupBy("doc")
        .agg(F.max(F.struct("shared", (-F.col("hub")).alias("neg"))).alias("m"))
        .select(F.col("doc").alias("b"), (-F.col("m.neg")).alias("a"))
    )
    sig = sk.filter("sig is not null and doc_id is not null").select("doc_id", "sig")
    likely = (
        best.join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
        .join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
        .filter(estimate(bits, k, "sig_a", "sig_b") >= least)
        .select("a", "b")
    )
    parents = stage(confirm(docs, stage(likely, "dup-pairs"), width, percent), "dup-parents")
    labels = jump(parents.groupBy(F.col("b").alias("doc")).agg(F.min("a").alias("label")))

    # smallest documents of a document's other buckets that have another label: the likeliest few
    met = named(named(members.filter("doc <> hub").select("doc", "hub"), labels, "doc", "la"), labels, "hub", "lb").filter("la <> lb").distinct()
    met = (
        stage(met, "dup-met")
        .join(sig.select(F.col("doc_id").alias("doc"), F.col("sig").alias("sig_b")), "doc")
        .join(sig.select(F.col("doc_id").alias("hub"), F.col("sig").alias("sig_a")), "hub")
        .withColumn("near", estimate(bits, k, "sig_a", "sig_b"))
        .filter(F.col("near") >= least)
        .withColumn("rank", F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("near"), "hub")))
        .filter(F.col("rank") <= hubs_asked)  # the others are held against each other below
        .select(F.col("hub").alias("a"), F.col("doc").alias("b"))
    )
    labels = linked(docs, labels, met, width, percent)

    labelled = stage(named(members.select("bucket", "doc"), labels, "doc", "label"), "dup-labelled")
    links = stage(label_links(compared(docs, labelled, sk.filter("sig is not null and doc_id is not null"), block), width, bits, most, percent, asked), "dup-found")
    if not links.isEmpty():
        labels = joined(labels, links)

    moved = classes.join(labels.select(F.col("doc").alias("rep"), "label"), "rep", "left").select("set_key", "n", F.coalesce("label", "rep").alias("component"), "rep")
    moved = stage(moved.filter("n > 1 or component <> rep").select("set_key", "component"), "dup-components")
    # documents without words have no set; their own ids keep them from meeting in one task
    key = F.coalesce("set_key", F.encode(F.col("doc_id").cast("string"), "utf-8"))
    return (
        sk.select("doc_id", "n_shingles", key.alias("set_key"))
        .join(moved, "set_key", "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
