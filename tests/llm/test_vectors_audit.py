from __future__ import annotations

import collections
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import divergence, hard_negatives, multiprobe

VECTORS = "vec_id long, embedding array<double>, label int, uid string, score int"


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def brute_audit(rows, min_docs, top):
    terms = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text or ""))) for text, lang, source in rows]
    seen, counts = collections.defaultdict(set), collections.Counter()
    for i, (lang, source, words) in enumerate(terms):
        for w in words:
            seen[lang, w].add(i)
            counts[lang, source, w] += 1
    out = []
    for lang in {t[0] for t in terms}:
        kept = [w for (x, w), docs in seen.items() if x == lang and len(docs) >= min_docs]
        groups = sorted({t[1] for t in terms if t[0] == lang})
        n = {g: sum(counts[lang, g, w] for w in kept) for g in groups}
        all_n = sum(n.values())

        def p(c, total, v=len(kept)):
            return 1 + 10**9 * (c + 1) // (total + v)

        def f(a, b):
            return (a - b) ** 2 // b

        for g in groups:
            pairs = [(sum(f(p(counts[lang, g, w], n[g]), p(counts[lang, h, w], n[h])) for w in kept), h) for h in groups if h != g]
            for rank, (value, h) in enumerate(sorted(pairs, key=lambda x: (-x[0], x[1].encode())), 1):
                out.append((lang, g, "pair", h, value, rank))
            found = []
            for w in kept:
                a, b = p(counts[lang, g, w], n[g]), p(sum(counts[lang, h, w] for h in groups), all_n)
                if counts[lang, g, w] and a > b:
                    found.append((f(a, b), w))
            for rank, (value, w) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:top], 1):
                out.append((lang, g, "term", w, value, rank))
    return sorted(out)


def audited(df, **how):
    return sorted(tuple(r) for r in divergence.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_audit_against_brute_force(spark, monkeypatch):
    r = random.Random(3)
    words = ["The", "the", "Über", "straße", "ÄÖ", "x", "日本", "né", "\U0001f600"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    weights = [200 / (i + 1) for i in range(len(words))]
    rows = []
    for i in range(160):
        n = r.choice([0, 3, 40, 150])
        text = " ".join(r.choices(words, weights, k=n)) + r.choice(["", "1a2b", "_the-THE."])
        rows.append((text, r.choice(["en", "en", "de", None]), r.choice(["a", "a", "b", "c", None, "ä"])))
    rows += [(None, "en", "silent"), ("", "fr", "a"), ("once only", "fr", "b"), ("lone", "xx", "one")] + rows[:3]
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("count", F.lit(1)).withColumn("term", F.lit("x"))
    want = brute_audit(rows, 3, 200)
    assert audited(df) == want
    # a long text in pieces, terms handed on early, narrow blocks counted in parts: the same rows
    long = [(" ".join(w for w, *_ in rows[:60] if w), "en", "a")]
    df = df.unionByName(spark.createDataFrame(long, "text string, lang string, source string"), allowMissingColumns=True)
    want = brute_audit(rows + long, 2, 5)
    assert audited(df, min_docs=2, top_terms=5) == want
    total = np.zeros((3, 3), "i8")
    monkeypatch.setattr(divergence, "CELLS", 7)
    divergence.add_block(total, {"a": 0, "b": 1, "c": 2}, [10, 4, 0], 3, 3, ["a", "a", "b"], [2, 8, 4], np.array([1, 2, 6], "<u8").tobytes())
    uses = {"a": [2, 8, 0], "b": [0, 4, 4], "c": [0, 0, 0]}
    n = {"a": 10, "b": 4, "c": 0}
    for (i, g), (j, h) in itertools.product(enumerate("abc"), repeat=2):
        p, q = ([divergence.share(c, n[x], 3) for c in uses[x]] for x in (g, h))
        assert total[i, j] == sum((a - b) ** 2 // b for a, b in zip(p, q, strict=True))


def test_long_texts_are_cut_between_terms(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 5)
    for text in ["", "abc", "abcdefghijk", "ab cd ef gh ij", "abcde fghij", "é" * 9 + " x" * 9, " " * 30 + "a"]:
        raw = text.encode()
        assert [w for p in divergence.pieces(raw) for w in divergence.TERM.findall(p)] == divergence.TERM.findall(raw)


def test_audit_of_odd_and_empty_tables(spark, odd_docs, no_docs):
    rows = [(r.text, r.lang, r.source) for r in odd_docs.select("text", "lang", "source").collect()]
    assert audited(odd_docs) == brute_audit(rows, 3, 200)
    assert audited(no_docs) == []


def brute_negatives(rows, every, positives=5, negatives=3):
    ok = [(i, v, [int(np.floor(256 * x)) for x in e], label) for i, (v, e, label) in enumerate(rows) if label is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    last = 1 << 62
    for a in ok:
        if a[1] is None or a[1] % every:
            continue
        near = [(-sum(x * y for x, y in zip(a[2], c[2], strict=False)), last if c[1] is None else c[1], c) for c in ok if c[0] != a[0]]
        near.sort(key=lambda x: x[:2])
        same = [x for x in near if x[2][3] == a[3]][:positives]
        for score, _, pos in same:
            hard = [x for x in near if x[2][3] != a[3] and 50 * -score <= 100 * -x[0] <= 95 * -score][:negatives]
            out += [(a[1], pos[1], rank, x[2][1], -score, -x[0]) for rank, x in enumerate(hard, 1)]
    return sorted(out, key=str)


def odd_vectors(n, seed, scale=1.0):
    g = np.random.default_rng(seed)
    base = g.standard_normal((5, 11))
    rows = [(i, (scale * (base[i % 5] + g.standard_normal(11) * 0.6)).tolist(), int(g.integers(0, 3)) if i % 17 else None) for i in range(n)]
    rows += [(7, None, 1), (10, [1.0, None], 1), (20, [float("nan")] * 11, 1), (30, [float("inf")] * 11, 0), (None, base[0].tolist(), 1), (41, [], 2), (50, [0.0] * 11, 2), (60, [1.0, -1.0], 1)]
    rows += [rows[0], rows[3], (12, rows[12][1], rows[12][2]), (10**9, rows[10][1], 2)] + [(1000 + i, rows[5][1], 1) for i in range(40)]
    return rows


def as_table(spark, rows):
    return spark.createDataFrame([(v, e, label, "x", 1) for v, e, label in rows], VECTORS)


@pytest.mark.parametrize("scale", [1.0, 2.0**12, 2.0**19])
def test_hard_negatives_against_brute_force(spark, monkeypatch, scale):
    rows = odd_vectors(120, 5, scale)  # the largest need Python's integers
    want = brute_negatives(rows, 5)
    df = as_table(spark, rows).repartition(3)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted((tuple(r) for r in hard_negatives.mine(df, "vec_id % 5 = 0").select(*names).collect()), key=str) == want and want
    monkeypatch.setattr(hard_negatives, "ANCHORS", 10)
    monkeypatch.setattr(hard_negatives, "CANDIDATES", (25, 25))
    assert sorted((tuple(r) for r in hard_negatives.mine(df, "vec_id % 5 = 0").select(*names).collect()), key=str) == want


def test_scores_beyond_64_bits(spark):
    rows = [(i, [1e30 * (1 + i % 3), 1.0], i % 2) for i in range(20)]
    got = hard_negatives.mine(as_table(spark, rows), "vec_id % 5 = 0").collect()
    assert all(r.positive_score == (1 << 63) - 1 for r in got)


def test_tables_give_inner_products():
    g = np.random.default_rng(1)
    for top in (3, 200, 2**20):
        a, c = g.integers(-top, top, (9, 13)), g.integers(-top, top, (30, 13))
        planes = hard_negatives.plane_bytes(c, hard_negatives.plane_count(c))
        wide = np.zeros((9, 16), "i8")
        wide[:, :13] = a
        assert (hard_negatives.scores(hard_negatives.subset_sums(wide), planes, np.int64) == c @ a.T).all()
        assert (hard_negatives.values_of(planes)[:, :13] == c).all()


def test_no_vectors(spark):
    none = as_table(spark, [])
    assert hard_negatives.mine(none, "vec_id % 5 = 0").count() == 0
    assert multiprobe.search(none, "vec_id % 5 = 0").count() == 0
    one = as_table(spark, [(5, [1.0, 2.0], 1)])
    assert hard_negatives.mine(one, "vec_id % 5 = 0").count() == 0
    assert multiprobe.search(one, "vec_id % 5 = 0").count() == 0


def brute_nearest(rows, every, k):
    ok = [(i, v, e) for i, (v, e, _) in enumerate(rows) if e is not None and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    out = []
    for i, v, e in ok:
        if v is None or v % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(e, f, strict=False)), 1 << 62 if w is None else w) for j, w, f in ok if j != i)[:k]
        out += [(v, rank, None if w == 1 << 62 else w, -s) for rank, (s, w) in enumerate(near, 1)]
    return sorted(out, key=str)


def searched(df, query, k, **how):
    return sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in multiprobe.search(df, query, k, **how).collect()), key=str)


def close(a, b):
    return len(a) == len(b) and all(x[:3] == y[:3] and abs(x[3] - y[3]) <= 1e-12 * max(1, abs(y[3])) for x, y in zip(a, b, strict=True))


def test_search_without_a_grid_is_exact(spark):
    rows = odd_vectors(120, 6)
    want = brute_nearest(rows, 4, 7)
    assert close(searched(as_table(spark, rows).repartition(3), "vec_id % 4 = 0", 7), want)


def test_search_finds_its_recall(spark, monkeypatch):
    monkeypatch.setattr(multiprobe, "CELL_VECTORS", 8)
    monkeypatch.setattr(multiprobe, "PART_VECTORS", 150)
    monkeypatch.setattr(multiprobe, "PART_QUERIES", 20)
    rows = odd_vectors(700, 8)
    want = brute_nearest(rows, 4, 10)
    got = searched(as_table(spark, rows).repartition(3), "vec_id % 4 = 0", 10)
    found, true = (collections.Counter((q, v) for q, _, v, _ in x) for x in (got, want))
    assert sum((found & true).values()) >= 0.9 * len(want)
    exact = collections.defaultdict(list)  # an id may stand for several vectors
    for q, _, v, score in brute_nearest(rows, 4, len(rows)):
        exact[q, v].append(score)
    assert all(min(abs(x - score) for x in exact[q, v]) < 1e-9 for q, _, v, score in got)
    # a sample that asks for everything visits every cell in reach
    assert sum((collections.Counter((q, v) for q, _, v, _ in searched(as_table(spark, rows), "vec_id % 4 = 0", 10, recall=1.0)) & true).values()) >= 0.95 * len(want)


def test_cells_are_visited_in_order_of_success():
    sets = multiprobe.boundary_orders(3, 100)
    assert len(sets) == 27 and len({tuple(s) for s in sets.tolist()}) == 27  # each coordinate stays or goes one way
    assert not sets[0].any() and sets[1].tolist() == [True] + [False] * 5
    grid = multiprobe.Grid(4, 1.0, 3, 27)
    q = grid.query_sphere(np.random.default_rng(2).standard_normal((50, 4)))
    own, inside = grid.places(q, 0)
    seen = grid.visited(q, 0)
    assert (seen[:, 0] == own).all() and all(len(set(row)) == 27 for row in seen.tolist())
    nearest_border = np.concatenate([inside, 1 - inside], 1).argmin(1)
    step = np.concatenate([-grid.factor[0], grid.factor[0]])
    assert (seen[:, 1] == own + step[nearest_border]).all()
