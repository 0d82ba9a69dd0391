from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.llm import chat, queries

CONV = "conv_id long, turn int, role string, text string, chosen int"
DATA = "/root/testdata/sf0.001"


def test_preferences(spark):
    rows = [
        (1, 0, "user", "hi", 0), (1, 1, "assistant", "yes", 0), (1, 2, "user", "bye", 0),
        (2, 1, "assistant", "no", 0), (2, 0, "user", "hi", 0),
        (3, 0, "user", "only", 0), (None, 0, "user", "lost", 0),
        (4, None, None, None, 0), (4, 0, "assistant", "yes", 0), (4, 0, "assistant", "yes", 0),
    ]
    got = {x.pair_id: x for x in chat.format_preferences(chat.alternatives(spark.createDataFrame(rows, CONV))).collect()}
    assert set(got) == {1, 2, 4} and [got[i].partner_id for i in (1, 2, 4)] == [2, 4, 1]
    one = got[1]
    assert one.n_prefix_turns == 1 and one.prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert one.chosen == "<|im_start|>assistant\nyes<|im_end|>\n" and one.rejected == "<|im_start|>assistant\nno<|im_end|>\n"
    (span,) = one.chosen_mask
    assert one.chosen[span.start : span.end] == "yes<|im_end|>\n"
    assert got[4].n_prefix_turns == 3 and got[4].chosen == "" == got[4].rejected and got[4].chosen_mask == []
    assert chat.alternatives(spark.createDataFrame([], CONV)).count() == 0


def test_prefix_and_masks_of_given_pairs(spark):
    t = "array<struct<role:string,text:string>>"
    a = [("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")]
    rows = [(1, a, [*a[:2], ("assistant", "x")]), (2, a, a[:3]), (3, None, a[:1]), (4, a[1:], a)]
    got = {x.pair_id: x for x in chat.format_preferences(spark.createDataFrame(rows, f"pair_id long, chosen {t}, rejected {t}")).collect()}
    assert [got[i].n_prefix_turns for i in (1, 2, 3, 4)] == [2, 3, 0, 0]
    assert [got[1].chosen[s.start : s.end] for s in got[1].chosen_mask] == ["a<|im_end|>\n", "b<|im_end|>\n"]
    assert got[2].rejected == "" and got[3].chosen == ""


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    assert docs.columns and [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "packing"]
    assert p.STAGES[2][1](spark, docs, DATA).columns == docs.columns
    pieces = p.run(spark, DATA)
    source = spark.read.parquet(f"{DATA}/documents.parquet")
    assert 0.8 * source.count() <= pieces.select("doc_id").distinct().count() <= source.count()
    assert pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").isEmpty()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_take_odd_rows(spark, odd_docs, no_docs):
    import corpus_pipeline as p

    for name, stage in p.STAGES:
        out, none = stage(spark, odd_docs, DATA), stage(spark, no_docs, DATA)
        assert none.count() == 0, name
        if name != "packing":
            assert out.columns == odd_docs.columns == none.columns, name
    # copies and rows that share an id leave one row; rows without words or without an id stay
    kept = [x.doc_id for x in p.deduplicated(spark, odd_docs, DATA).collect()]
    assert sorted(kept, key=lambda k: (k is None, k)) == [1, 2, 3, 4, 6, 8, 9, None]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages_against_brute_force(spark):
    import re

    import corpus_pipeline as p

    from .test_text import brute_components

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(x.doc_id, x.text) for x in docs.collect()]
    group = brute_components(rows, 5, 80)
    deduplicated = p.deduplicated(spark, docs, DATA)
    assert sorted(x.doc_id for x in deduplicated.collect()) == sorted(d for d, _ in rows if group[d] == d)

    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    windows = set()
    for x in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(x.text)
        windows |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)} if len(w) >= 10 else {tuple(w)} - {()}
    sizes = {len(w) for w in windows}

    def hit(t):
        w = words(t)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    assert sorted(x.doc_id for x in p.decontaminated(spark, docs, DATA).collect()) == sorted(d for d, t in rows if not hit(t))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_queries_agree_with_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def plain(v):
        if hasattr(v, "asDict"):
            return plain(v.asDict())
        if isinstance(v, dict):
            return {k: plain(x) for k, x in v.items()}
        return [plain(x) for x in v] if isinstance(v, list) else v

    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, DATA)
        cols = sorted(got.columns)
        res = con.execute(sql)
        names = [c[0] for c in res.description]
        want = sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in res.fetchall())
        assert sorted(repr([plain(r[c]) for c in cols]) for r in got.collect()) == want, name
