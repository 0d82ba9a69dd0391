from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import packing, token_store
from pulsegrid.llm.tokens import Encoder, encoder, tokenizer_path

FILES = {"word_bpe_49k.json": False, "byte_bpe_50k.json": True}


@lru_cache
def library(name):
    """A tokenizer of its own, with the library's defaults."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path(name))


def reference(name, text):
    return library(name).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
@given(text=st.text(alphabet=st.one_of(st.sampled_from("ab Ztheé'sñ.,!?-\n\t\r\x0b\x1c\x85  $19ΣİÀß́"), st.characters(codec="utf-8")), max_size=60))
@settings(max_examples=300, deadline=None)
def test_blocks_encode_as_whole_texts(name, text):
    got = encoder(tokenizer_path(name), FILES[name]).encode_all([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == reference(name, text)


@pytest.mark.parametrize("name", FILES)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("abcXYZ éÉßÿ×÷'s.,!?-##\n\t\r\x0b\x1c\x85\xa0\u2003 12\u0301…日"), max_size=40), max_size=12))
@settings(max_examples=300, deadline=None)
def test_many_texts_at_once(name, texts):
    texts = [*texts, None, ""]
    got = encoder(tokenizer_path(name), FILES[name]).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [reference(name, t) for t in texts]


@pytest.mark.parametrize("name", FILES)
def test_cache_may_start_anew(name):
    e = Encoder(tokenizer_path(name), FILES[name], cache_blocks=3)
    assert e.direct
    texts = ["one two three four " + "x" * 5000, "five six seven <|endoftext|> " + "ab." * 900, "one more"]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(e.encode_all([t])[0], "<u4").tolist() == reference(name, t)
    assert max(map(len, e.cache)) <= 256


def test_packing_keeps_every_id(spark, odd_docs):
    rows = packing.pack(odd_docs, with_ids=True).collect()
    for doc in odd_docs.select("doc_id", "text").distinct().collect():
        ids = np.array([*reference("byte_bpe_50k.json", doc.text), 1], "<u4")
        own = sorted((r for r in rows if r.doc_id == doc.doc_id), key=lambda r: r.start)
        copies = odd_docs.filter(odd_docs.doc_id.eqNullSafe(doc.doc_id)).count()
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            part = ids[r.start : r.start + r.length].tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and bytes(r.ids) == part and r.doc_tokens == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.sequence_tokens == at for r in own)
    padding = sum(0 if (n := sum(r.length for r in own)) & (n - 1) == 0 else 2048 - n for own in by.values())
    assert padding <= 0.03 * sum(r.length for r in rows)


def test_class_bins_hold_a_fixed_number():
    p = packing.Packer(2048, 64, 1 / 64, 0)
    for i in range(6):
        p.add(i, bytes(4 * 680))  # class 3: at most 682
    assert [len([r for r in p.rows if r[5] == s]) for s in (0, 1)] == [3, 3]


def test_sequences_and_empty(spark, odd_docs, no_docs):
    s = packing.sequences(packing.pack(odd_docs, with_ids=True)).collect()
    assert all(len(r.ids) == 2048 or len(r.ids) & (len(r.ids) - 1) == 0 for r in s)
    assert packing.pack(no_docs).count() == 0


@given(st.lists(st.integers(0, 60000), max_size=1500))
@settings(max_examples=60, deadline=None)
def test_wavelet_matrix_round_trip(ids):
    a = np.array(ids, "<u4")
    shard = token_store.Shard.of(token_store.build([5, None], [len(ids), 0], a))
    assert shard.decode().tolist() == ids and shard.docs()[0] == [5, None]
    for i in range(0, len(ids), 97):
        assert shard.access(i) == ids[i]
    for t in {*ids[:3], 1, 2**31 - 1}:
        assert shard.count(t) == ids.count(t)
        places = [i for i, x in enumerate(ids) if x == t]
        assert [shard.select(t, n) for n in range(len(places))] == places and shard.select(t, len(places)) == -1
        assert shard.rank(t, len(ids) // 2) == ids[: len(ids) // 2].count(t)


def test_store_reads_back_in_order(spark, odd_docs, no_docs):
    manifest, folder = token_store.store_tokens(odd_docs, shard_tokens=500)
    rows = token_store.read_shards(manifest, folder).collect()
    want, at = [], 0
    docs = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for d in docs:
        ids = np.array([*reference("word_bpe_49k.json", d.text), 2], "<u4")
        want.append((d.doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, rows), key=key) == want
    manifest, folder = token_store.store_tokens(no_docs)
    assert token_store.read_shards(manifest, folder).count() == 0


@pytest.mark.parametrize("name", FILES)
@given(parts=st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", "a", "the", " ", "  ", "\n", "\t", "É", "é", "'s", "1", ".", "<", ">"]), max_size=16))
@settings(max_examples=300, deadline=None)
def test_added_tokens_as_the_library_has_them(name, parts):
    text = "".join(parts)
    got = np.frombuffer(encoder(tokenizer_path(name), FILES[name]).encode_all([text])[0], "<u4").tolist()
    assert got == library(name).encode(text, add_special_tokens=False).ids


def test_added_token_has_its_id():
    got = encoder(tokenizer_path("word_bpe_49k.json"), False).encode_all(["a <|endoftext|> b"])[0]
    assert np.frombuffer(got, "<u4").tolist() == [320, 49407, 321]
