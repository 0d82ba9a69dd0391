"""Audit of what sets the sources of a language apart, on count-level bitmaps.

How often a source uses a term, and so its smoothed share p of the term, depends
on the term's count alone, and few counts occur.  For each (source, count) level
a block of terms has a bit set of the terms with that count.  AND and a popcount
of two levels give the number of terms in the joint cell of two sources, which
times the cell's divergence f gives the cell's part of the sum.  Count zero has
no bit set: its cells follow by complement from the cells that are known.

Blocks take terms in order of falling totals, so that frequent terms with counts
all their own stand in narrow blocks, and rare terms, whose few counts repeat,
in wide ones of many words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, stage

#: ASCII letters and everything beyond ASCII, on the bytes of UTF-8 (whose multi-byte characters have no byte below 0x80).
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
#: Characters of a text that are cut into terms at once, and distinct terms that a worker counts before it hands them on.
PIECE = 1 << 20
HELD_TERMS = 300_000
#: Shares are in billionths.
ONE = 10**9
#: Groups (languages' sources) up to which their totals are broadcast, some 50 bytes each.
BROADCAST_GROUPS = 200_000
#: A block's terms, and the bytes of its bit sets.
BLOCK_TERMS = 1 << 16
BLOCK_BYTES = 4 << 20
#: Cells of level pairs that are counted at once.
CELLS = 1 << 20

COUNTS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("lang", "source", "term")] + [T.StructField(n, T.LongType()) for n in ("count", "docs")]
)
LEVELS = T.StructType(
    [
        T.StructField("lang", T.StringType()),
        T.StructField("terms", T.LongType()),
        T.StructField("sources", T.ArrayType(T.StringType())),
        T.StructField("counts", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()),
    ]
)
PAIRS = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("lang", "source", "item")] + [T.StructField("value", T.LongType())]
)


def pieces(raw: bytes):
    """A long text in pieces that end where no term goes on."""
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        m = TERM.match(raw, end)
        end = m.end() if m else end  # a term over the edge stays whole
        yield raw[at:end]
        at = end
    yield raw[at:] if at else raw


def strings(a: pa.Array):
    """A column's values as UTF-8 bytes, null as none."""
    for v in a.cast(pa.binary() if a.type == pa.string() else pa.large_binary()):
        yield v.as_py() or b""


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, count, docs`` with one row a group and term; ``docs`` counts its rows."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(COUNTS)

    def run(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}

        def hand_on():
            for (lang, source), (counts, seen) in held.items():
                terms = list(counts)
                for i in range(0, len(terms), 50_000):
                    part = terms[i : i + 50_000]
                    cols = [
                        pa.array([lang] * len(part)),
                        pa.array([source] * len(part)),
                        pa.array(part, pa.binary()).cast(pa.string()),
                        pa.array([counts[t] for t in part], pa.int64()),
                        pa.array([seen[t] for t in part], pa.int64()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, schema=schema)
            held.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang, source, raw in zip(langs, sources, strings(batch.column(2)), strict=True):
                if (lang, source) not in held:
                    held[lang, source] = Counter(), Counter()
                counts, seen = held[lang, source]
                if len(raw) <= PIECE:
                    found = TERM.findall(raw.lower())
                    counts.update(found)
                    seen.update(set(found))
                else:
                    own: set = set()
                    for piece in pieces(raw.lower()):
                        found = TERM.findall(piece)
                        counts.update(found)
                        own.update(found)
                    seen.update(own)
            if sum(len(c) for c, _ in held.values()) > HELD_TERMS:
                yield from hand_on()
        yield from hand_on()

    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    bounded_batches(docs.sparkSession)
    # dealt by what the next step groups by, so that one shuffle serves both
    parts = docs.select(*cols).mapInArrow(run, COUNTS).repartition("lang", "term")
    return parts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term, total, used``: terms in at least ``min_docs`` documents of the language, with the sources that use them."""
    used = F.collect_list(F.struct("source", "count")).alias("used")
    each = counts.groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"), used)
    return each.filter(F.col("docs") >= min_docs).drop("docs")


def level_blocks(terms: DataFrame) -> DataFrame:
    """Bit sets of term ids for each (source, count), in blocks of terms of one language."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(LEVELS)

    def run(batches):
        lang, n, levels, sources = None, 0, {}, set()

        def close():
            keys = sorted(levels)
            words = -(-n // 64)
            bits = np.zeros((len(keys), words * 64), bool)
            for row, key in enumerate(keys):
                bits[row, levels[key]] = True
            packed = np.packbits(bits, axis=1, bitorder="little").tobytes()
            cols = [[lang], [n], [[s for s, _ in keys]], [[c for _, c in keys]], [packed]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for name, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                full = n % 64 == 0 and (len(levels) >= 25 * len(sources) or n >= BLOCK_TERMS or len(levels) * n // 8 >= BLOCK_BYTES)
                if n and (name != lang or full):
                    yield close()
                    n, levels, sources = 0, {}, set()
                lang = name
                for u in used:
                    levels.setdefault((u["source"], u["count"]), []).append(n)
                    sources.add(u["source"])
                n += 1
        if n:
            yield close()

    order = ["lang", F.desc("total"), "term"]
    dealt = terms.repartitionByRange(*order).sortWithinPartitions(*order).select("lang", "used")
    return dealt.mapInArrow(run, LEVELS)


def share(count: int, all_counts: int, kept: int) -> int:
    return 1 + ONE * (count + 1) // (all_counts + kept)


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of shares up to a billion and one: squares stay below 2^63."""
    return (p - q) ** 2 // q


def add_block(total: np.ndarray, at: dict, n_all: list, kept: int, n: int, sources: list, counts: list, bits: bytes) -> None:
    """Add a block's cells to ``total[g, h]``, the sum of f with p of source g and q of source h."""
    k, s = len(sources), len(n_all)
    words = np.frombuffer(bits, "<u8").reshape(k, -1)
    src = np.array([at[x] for x in sources])
    p = np.array([share(c, n_all[g], kept) for c, g in zip(counts, src.tolist(), strict=True)], "i8")
    zero = np.array([share(0, x, kept) for x in n_all], "i8")
    size = np.bitwise_count(words).sum(1, dtype="i8")
    met = np.zeros((k, s), "i8")  # terms of a level that a source uses, at any count
    step = max(1, CELLS // k)
    for a in range(0, k, step):
        joint = np.zeros((min(step, k - a), k), "i4")
        for w in range(words.shape[1]):
            joint += np.bitwise_count(words[a : a + step, None, w] & words[None, :, w])
        i, j = np.nonzero(joint)
        n_terms = joint[i, j].astype("i8")
        i += a
        np.add.at(total, (src[i], src[j]), n_terms * gap(p[i], p[j]))
        np.add.at(met, (i, src[j]), n_terms)
    missed = size[:, None] - met  # used here, not there
    np.add.at(total, src, missed * gap(p[:, None], zero[None, :]))
    np.add.at(total.T, src, missed * gap(zero[None, :], p[:, None]))
    uses, both = np.zeros(s, "i8"), np.zeros((s, s), "i8")
    np.add.at(uses, src, size)
    np.add.at(both, src, met)
    total += (n - uses[:, None] - uses[None, :] + both) * gap(zero[:, None], zero[None, :])


def pair_sums(blocks: DataFrame) -> DataFrame:
    """``lang, source, item, value`` summed over the blocks of each task; blocks carry ``n_sources, n_counts, kept``."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(PAIRS)

    def run(batches):
        sums: dict[str, tuple[list, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: c.slice(i, 1).to_pylist()[0] for name, c in zip(batch.schema.names, batch.columns, strict=True)}
                names = row["n_sources"]
                if row["lang"] not in sums:
                    sums[row["lang"]] = names, np.zeros((len(names), len(names)), "i8")
                at = {x: k for k, x in enumerate(names)}
                add_block(sums[row["lang"]][1], at, row["n_counts"], row["kept"], row["terms"], row["sources"], row["counts"], row["bits"])
        for lang, (names, total) in sums.items():
            for k, name in enumerate(names):
                cols = [[lang] * len(names), [name] * len(names), names, total[k].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    names = ["lang", "terms", "sources", "counts", "bits", "kept", "n_sources", "n_counts"]
    return blocks.select(*names).mapInArrow(run, PAIRS)


def share_of(count: Column, all_counts: Column, kept: Column) -> Column:
    """``share`` as a column, in decimals: a billion times a count may pass 64 bits."""
    d = T.DecimalType(20, 0)
    up = F.lit(ONE).cast(T.DecimalType(10, 0)) * (count.cast(d) + F.lit(1)).cast(d)
    return F.lit(1) + F.call_function("div", up, (all_counts.cast(d) + kept.cast(d)).cast(d))


def with_small(df: DataFrame, small: DataFrame, on: list[str], n: int) -> DataFrame:
    return df.join(F.broadcast(small) if n <= BROADCAST_GROUPS else small, on)


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """How far each source is from the other sources of its language, and by which terms from the language.

    ``docs(text, lang, source)``; nulls count as empty, other columns are ignored
    and each row is a document, repeated or not.  A language keeps the terms of
    at least ``min_docs`` documents.  Part ``pair`` has the other sources of the
    language by falling divergence; part ``term`` the ``top_terms`` terms that
    the source uses more than the language does.  Ties go by item in UTF-8 order.
    A source without terms has pairs (with its smoothed shares) and no terms; a
    language with one source has no pairs; no rows give no rows.
    """
    spark = docs.sparkSession
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = stage(docs.select(*text).distinct(), "audit-groups")
    terms = stage(kept_terms(term_counts(docs), min_docs), "audit-terms")
    uses = terms.select("lang", "term", "total", F.explode("used").alias("u")).select("lang", "term", "total", "u.source", "u.count")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("total").alias("n_lang"))
    of_group = uses.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    zero = F.lit(0).cast("long")
    totals = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    totals = stage(totals.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("n", "kept", "n_lang")]), "audit-totals")
    n_groups = totals.count()

    each = F.sort_array(F.collect_list(F.struct("source", "n")))
    langs = totals.groupBy("lang").agg(F.first("kept").alias("kept"), each.alias("s"))
    langs = langs.select("lang", "kept", F.col("s.source").alias("n_sources"), F.col("s.n").alias("n_counts"))
    levels = stage(level_blocks(terms), "audit-levels")
    bounded_batches(spark)
    sums = pair_sums(with_small(levels, langs, ["lang"], n_groups))
    # every pair, for languages that keep no term
    other = langs.select("lang", F.explode("n_sources").alias("source"), "n_sources").select("lang", "source", F.explode("n_sources").alias("item"), zero.alias("value"))
    pairs = sums.union(other).filter("source != item").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))

    p, q = share_of(F.col("count"), F.col("n"), F.col("kept")), share_of(F.col("total"), F.col("n_lang"), F.col("kept"))
    found = with_small(uses, totals, ["lang", "source"], n_groups).select("lang", "source", "term", p.alias("p"), q.alias("q")).filter("p > q")
    found = found.select("lang", "source", F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    cols = ["lang", "source", "item", "value", rank]
    both = pairs.select(F.lit("pair").alias("part"), *cols).unionByName(found.select(F.lit("term").alias("part"), *cols).filter(F.col("rank") <= top_terms))
    return both.select("lang", "source", "part", "item", "value", "rank")
