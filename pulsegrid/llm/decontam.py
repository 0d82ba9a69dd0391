"""Benchmark decontamination by a broadcast hash set of word windows.

The windows of ``size`` words of all benchmark items (an item with fewer words
is one window) are hashed over numbers given to the benchmark's own words, and
sent to every executor in blocks of bounded size.  A document's words become
those numbers, 0 for any other word; rolling hashes of its windows are looked
up, and a hit counts only if the numbers themselves agree.  Beyond one block the
documents pass once for each, carrying what the blocks before found in a written
table: driver and executors hold one block's hash set at a time.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_rows, map_batches, stage

#: A-Z become a-z, digits and bytes of other letters stay, all else parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

SCAN = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType(), False)),
        T.StructField("items", T.ArrayType(T.StringType(), False)),
    ]
)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Windows:
    """The hash set of one block of items, ``[(item_id, text)]``."""

    def __init__(self, items: list[tuple], size: int):
        self.vocab: dict[bytes, int] = {}
        found: dict[int, dict[tuple, dict]] = {}
        named: dict[str | None, dict[str, None]] = {}
        for item, text in items:
            named.setdefault(text, {}).update({} if item is None else {str(item): None})
        for text, names in named.items():
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words(text)]
            n = min(size, len(ids))
            for i in range(len(ids) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(ids[i : i + n]), {}).update(names)
        self.tables = {}
        for n, windows in found.items():
            rows = np.array(list(windows), "i8").reshape(-1, n)
            for seed in range(64):
                weights = np.random.default_rng(seed).integers(1, 1 << 63, n, "u8") | np.uint64(1)
                keys = (rows.view("u8") * weights).sum(axis=1, dtype="u8")
                if len(np.unique(keys)) == len(keys):
                    break
            order = np.argsort(keys)
            names = list(windows.values())
            self.tables[n] = (weights, keys[order], rows[order], [names[i] for i in order.tolist()])

    def scan(self, texts: list) -> tuple[list[int], list[list[tuple[int, int]]], list[set]]:
        """Word counts, hit word spans and items hit, for each text."""
        sizes, parts = [], []
        for t in texts:
            w = words(t)
            sizes.append(len(w))
            parts.append(np.fromiter(map(self.vocab.get, w, repeat(0)), "i8", len(w)))
            parts.append(np.zeros(1, "i8"))  # no window runs into the next text
        ids = np.concatenate(parts) if parts else np.zeros(0, "i8")
        begins = np.cumsum([0, *(s + 1 for s in sizes)])
        spans: list[list] = [[] for _ in texts]
        items: list[set] = [set() for _ in texts]
        strange = np.concatenate([[0], np.cumsum(ids == 0)])
        for n, (weights, keys, rows, names) in self.tables.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(strange[n:] == strange[:-n])
            if not len(at):
                continue
            h = np.zeros(len(at), "u8")
            for i in range(n):
                h += ids[at + i].view("u8") * weights[i]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            at, place = at[hit], place[hit]
            true = (ids[at[:, None] + np.arange(n)] == rows[place]).all(axis=1) if len(at) else np.zeros(0, bool)
            at, place = at[true], place[true]
            doc = np.searchsorted(begins, at, side="right") - 1
            for d, a, p in zip(doc.tolist(), (at - begins[doc]).tolist(), place.tolist(), strict=True):
                items[d].update(names[p])
                if spans[d] and spans[d][-1][0] <= a <= spans[d][-1][1]:
                    spans[d][-1] = (spans[d][-1][0], max(spans[d][-1][1], a + n))
                else:
                    spans[d].append((a, a + n))
        return sizes, spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame, block_chars: int) -> int:
    """How many blocks hold the benchmark at about ``block_chars`` characters each."""
    texts = benchmark.select(F.col("text").cast("string").alias("text")).distinct()
    total = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    return max(1, -(-total // block_chars))


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = 32 << 20, keep_text: bool = False) -> DataFrame:
    """Hit spans for each row of ``docs(doc_id, text)``.

    ``spans`` holds word numbers, begin and end of each merged span in turn;
    ``items`` the item_ids, as strings.  Null or wordless texts have no words;
    an item without words has no windows; windows of an item without an id do
    hit but name no item.  Repeated rows are scanned each for itself.  Other
    columns of either table are ignored.
    """
    spark = docs.sparkSession
    empty = [F.lit(0).cast("long").alias("n_words"), F.array().cast("array<long>").alias("spans"), F.array().cast("array<string>").alias("items")]
    out = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"), *empty)
    n = blocks(benchmark, block_chars)
    for i in range(n):
        windows = spark.sparkContext.broadcast(block_windows(benchmark, size, i, n))
        last = i == n - 1

        def run(rows, w, bare=last and not keep_text):
            sizes, spans, items = w.scan(rows["text"])
            return {
                "doc_id": rows["doc_id"],
                "text": [None] * len(sizes) if bare else rows["text"],
                "n_words": sizes,
                "spans": [[x for s in merged([*zip(old[::2], old[1::2], strict=True), *new]) for x in s] for old, new in zip(rows["spans"], spans, strict=True)],
                "items": [sorted({*old, *new}) for old, new in zip(rows["items"], items, strict=True)],
            }

        out = map_batches(out, run, SCAN, setup=lambda w=windows: w.value)
        if not last:
            out = stage(out, "decontam-block")
            windows.destroy()
    return out


def block_windows(benchmark: DataFrame, size: int, i: int, n: int) -> Windows:
    """The hash set of the benchmark's block number ``i`` of ``n``, of bounded size; equal texts are one."""
    source = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter("text is not null")
    part = source.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == i) if n > 1 else source
    held = part.groupBy("text").agg(F.sort_array(F.collect_set("item")).alias("items")).collect()
    return Windows([(item, r["text"]) for r in held for item in r["items"] or [None]], size)


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_chars: int = 32 << 20) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, with all their columns."""
    n = blocks(benchmark, block_chars)
    for i in range(n):
        windows = docs.sparkSession.sparkContext.broadcast(block_windows(benchmark, size, i, n))
        docs = keep_rows(docs, lambda texts, w: [not s for s in w.scan(texts)[1]], windows)
        if i < n - 1:
            docs = stage(docs, "decontam-clean")
            windows.destroy()
    return docs


def digest(scanned: DataFrame) -> DataFrame:
    """Counts and the digest of the items for each scanned row."""
    hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda s, x: s + x)
    return scanned.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cut_spans(text: str, spans: list[int]) -> str:
    """The text without the words of the spans and what stands between them."""
    found = [m.span() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[at : found[a][0]])
        at = found[b - 1][1]
    return "".join([*out, text[at:]])


def remove_spans(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """``doc_id, text`` with hit spans cut out, again and again until none is left."""

    @F.udf(T.StringType())
    def cut(text, spans):
        return cut_spans(text, spans) if text is not None and spans else text

    out = docs.select("doc_id", "text")
    hits = True
    while hits:
        found = stage(scan(out, benchmark, size, keep_text=True), "decontam")
        hits = not found.filter(F.size("spans") > 0).isEmpty()
        out = found.select("doc_id", cut("text", "spans").alias("text"))
    return out


__all__ = ["TABLE", "Windows", "block_windows", "blocks", "cut_spans", "digest", "keep_clean", "merged", "remove_spans", "scan", "words"]
