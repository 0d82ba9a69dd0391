from __future__ import annotations

import io
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pulsegrid.llm import html_extract as h
from pulsegrid.llm import warc_zip as w

SENTENCE = "The cat is on the mat and it was the best of times for all of them in the house."
PAGES = "page_id long, url string, html string, text string, n_chars string"


def page(body, head=""):
    return f"<html><head><title>T</title>{head}</head><body>{body}</body></html>"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        (page(f"<nav><a href=x>Home</a></nav><article><h1>Short title</h1><p>{SENTENCE}<p>a &lt; b&nbsp;&amp;\n c</article><footer>{SENTENCE}</footer>"), f"Short title {SENTENCE} a < b & c"),
        (page(f"<div class='cookie-notice'>{SENTENCE}</div><main><p>{SENTENCE}</p><form>{SENTENCE}</form><script>var t='</p>';</script><!-- {SENTENCE} --><style>p{{}}</style></main>"), SENTENCE),
        (page(f"<article><p>{SENTENCE}</p></article><section id=comments><p>{SENTENCE} {SENTENCE}</p></section><aside>{SENTENCE}</aside>"), SENTENCE),
        (page(f"<div><p>{SENTENCE} {SENTENCE} {SENTENCE}</p><p>Brief.</p><p>{SENTENCE} {SENTENCE} {SENTENCE}</p></div><ul><li><a href=1>{SENTENCE}</a></ul>"), f"{SENTENCE} {SENTENCE} {SENTENCE} Brief. {SENTENCE} {SENTENCE} {SENTENCE}"),
        (page(f"<article><p>un<b>bo</b>ld <i>{SENTENCE}</p><p>one<br>two"), f"unbold {SENTENCE} one two"),
    ],
)
def test_main_text(html, text):
    assert h.main_text(html, h.Rules()) == text


LONG = f"{SENTENCE} {SENTENCE} {SENTENCE}"
RUSSIAN = "Утром город медленно просыпается, и первые трамваи идут по мокрым улицам мимо старых домов. " * 3
JAPANESE = "朝の町はゆっくりと目を覚まし、最初の電車が古い家の並ぶ濡れた通りを静かに走っていく。川の上には白い霧が残り、橋の下を小さな船が進んでいる。市場では店の人たちが野菜や魚を並べはじめる。"


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # names that tell of a layout
        (page(f"<div id='page' class='site no-sidebar'><article><p>{LONG}</p></article></div>"), LONG),
        (page(f"<div class='has-sidebar'><article><p>{LONG}</p></article><div class='sidebar'><p>{LONG}</p></div></div>"), LONG),
        (page(f"<div class='search-result'><p>{LONG}</p></div><div class='share-enabled'><p>{LONG}</p></div>"), f"{LONG} {LONG}"),
        # most of the page's text outweighs a name, but not what readers write
        (page(f"<div class='banner'><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div>"), f"{LONG} {LONG} {LONG}"),
        (page(f"<div class='post-comments'><p>{LONG}</p><p>{LONG}</p></div><div><p>{LONG}</p></div>"), LONG),
        (page(f"<div class='promo'><p>{LONG}</p><p>{LONG}</p></div><article><p>{SENTENCE}</p></article>"), SENTENCE),
        # the slash of a script means nothing
        (page(f"<article><p>{SENTENCE}</p></article><script src='x'/>var a = 1; for (;;) {{}}</script>"), SENTENCE),
        (page(f"<article><p>{SENTENCE}</p><style/>p {{}}</style><svg viewBox='0'/><p>{SENTENCE}</p></article>"), f"{SENTENCE} {SENTENCE}"),
        # languages without a list of stop words
        (page(f"<nav><a href=1>Главная</a></nav><div><p>{RUSSIAN}</p><p>{RUSSIAN}</p></div><ul><li><a href=2>Ещё новости дня</a></ul>"), f"{RUSSIAN.strip()} {RUSSIAN.strip()}"),
        (page(f"<nav><a href=1>ホーム</a></nav><div><p>{JAPANESE}</p><p>{JAPANESE}</p></div><ul><li><a href=2>他の記事</a></ul>"), f"{JAPANESE} {JAPANESE}"),
        # formulas are text
        (page(f"<article><p>{SENTENCE} <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>"), f"{SENTENCE} x=2 holds."),
    ],
)
def test_main_text_of_ordinary_pages(html, text):
    assert h.main_text(html, h.Rules()) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        # names that are an article's own subject
        (page(f"<div id='feedback-loops'><p>{LONG}</p><p>{SENTENCE}</p></div>"), f"{LONG} {SENTENCE}"),
        (page(f"<article><p>{LONG}</p><section id='discussion'><h2>Discussion</h2><p>{LONG}</p></section></article>"), f"{LONG} {LONG}"),
        (page(f"<article><p class='trending-topic'>{SENTENCE}</p><div class='widget-text'>{SENTENCE}</div><label>{SENTENCE}</label></article>"), f"{SENTENCE} {SENTENCE} {SENTENCE}"),
        (page(f"<article><p>{SENTENCE}</p><div class='share-this-story'>Share now</div><div class='related-stories'><p><a href=1>{SENTENCE}</a></div></article>"), SENTENCE),
        (page(f"<article><p>{SENTENCE}</p><div class='comment-list'><p>{LONG}</p></div><div class='discussion'><div class='comment'><p>{LONG}</p></div></div></article>"), SENTENCE),
        # short blocks
        ("<h1>Storm</h1><p>The storm hit the town on Friday.</p><p>No one was hurt.</p>", "Storm The storm hit the town on Friday. No one was hurt."),
        ("Just a bare text.", "Just a bare text."),
        (page("<nav><a href=1>Home</a></nav><p>One short.</p><p><a href=2>Next page</a></p>"), "One short."),
        (page(f"<div><p>{LONG}</p><p>He said no.</p><p>So did she.</p></div><div>Site 2024</div>"), f"{LONG} He said no. So did she."),
        (page(f"<div><p>Dear all,</p><p>{LONG}</p></div>"), f"Dear all, {LONG}"),
    ],
)
def test_names_and_short_blocks(html, text):
    assert h.main_text(html, h.Rules()) == text


def test_deep_pages_take_one_pass():
    import time

    begun = time.time()
    h.main_text("<div>" * 60_000 + "</b></span></section>" * 60_000 + "text", h.Rules())
    assert time.time() - begun < 20


def brute_settle(labels, article):
    """The second pass from its words: for each open block look both ways for the nearest decided one."""
    out = []
    for i, x in enumerate(labels):
        if isinstance(x, bool):
            out.append(x)
            continue
        ways = (range(i - 1, -1, -1), range(i + 1, len(labels)))
        a, b = (next((labels[j] for j in way if article[j] == article[i] and isinstance(labels[j], bool)), None) for way in ways)
        if a is None and b is None:
            out.append(article[i] or x == "near")
        elif a is None or b is None:
            one = b if a is None else a
            out.append(one if article[i] else one and x == "near")
        else:
            out.append(a if a == b else x == "near")
    return out


@given(st.lists(st.tuples(st.sampled_from([True, False, "near", "short"]), st.booleans()), max_size=30))
@settings(max_examples=400, deadline=None)
def test_second_pass_against_brute_force(blocks):
    labels, article = [b[0] for b in blocks], [b[1] for b in blocks]
    assert h.settle(labels, article) == brute_settle(labels, article)


@given(st.randoms(use_true_random=False), st.sampled_from(["article", "main", "div"]))
@settings(max_examples=150, deadline=None)
def test_generated_pages_give_their_article(r, holder):
    words = "the of and to in is that it was for on are as with his they be at one have this from by not but what all were when we there can an".split() + [f"wort{i}" for i in range(30)]
    some = lambda n: " ".join(r.choice(words) for _ in range(n))
    paragraphs = [some(r.randint(60, 120)) for _ in range(r.randint(1, 6))]
    links = lambda: "".join(f"<li><a href='/{i}'>{some(3)}</a>" for i in range(r.randint(1, 9)))
    noise = [
        lambda: f"<nav><ul>{links()}</ul></nav>",
        lambda: f"<aside><p>{some(40)}</p></aside>",
        lambda: f"<div class='{r.choice(['ad-slot', 'cookie-bar', 'newsletter', 'user-comments', 'share'])}'><p>{some(20)}</p></div>",
        lambda: f"<script>var s = '<p>{some(20)}</p>'</script>",
        lambda: f"<!-- <p>{some(30)}</p> --><form><p>{some(30)}</p></form>",
        lambda: f"<footer><p>{some(30)}</p></footer>",
    ]
    around = lambda: "".join(r.choice(noise)() for _ in range(r.randint(0, 3)))
    inner = "".join(f"<p>{p}</p>" + (r.choice(noise)() if r.random() < 0.3 else "") for p in paragraphs)
    got = h.main_text(page(f"{around()}<{holder}>{inner}</{holder}>{around()}"), h.Rules())
    assert got == " ".join(paragraphs)


def test_extract_handles_odd_rows(spark):
    long = page("<article>" + f"<p>{SENTENCE}</p>" * 5000 + "</article>")
    rows = [(1, "u", None, "x", "y"), (1, "u", None, "x", "y"), (None, None, page("<article>x</article>"), None, None), (2, "u", long, "x", "y")]
    got = h.extract(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (1, 0), (1, 0), (2, 5000 * (len(SENTENCE) + 1) - 1)]
    assert h.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_archives_round_trip(spark, monkeypatch):
    rows = [(1, "http://a", "same", "x", "y"), (3, "http://b", "same", None, None), (2, None, "same", "x", "y"), (4, "http://d e", None, "x", "y"), (5, "http://e", "", "x", "y"), (None, "http://f", "other", "x", "y"), (6, "http://g", "é" * 70000, "x", "y")]
    for limit in (w.BROADCAST_ROWS, 0):
        monkeypatch.setattr(w, "BROADCAST_ROWS", limit)
        folder = w.new_folder(spark, "t")
        got = {r.page_id: r for r in w.read_archives(w.write_archives(spark.createDataFrame(rows, PAGES), folder, archive_bytes=200), folder).collect()}
        assert len(got) == 7
        assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("revisit", 3), 2: ("revisit", 3), 3: ("response", None), 4: ("revisit", 5), 5: ("response", None), None: ("response", None), 6: ("response", None)}
        assert got[6].payload_bytes == 140000 and got[1].payload_bytes == 4 and got[1].payload_digest == w.digest(b"same")
        assert got[4].url == "http://d e" and got[2].url is None
    folder = w.new_folder(spark, "t")
    assert w.read_archives(w.write_archives(spark.createDataFrame([], PAGES), folder), folder).count() == 0


def test_small_payloads_are_responses(spark):
    folder = w.new_folder(spark, "t")
    rows = [(1, "u", "ab", "", ""), (2, "u", "ab", "", "")]
    got = w.read_archives(w.write_archives(spark.createDataFrame(rows, PAGES), folder, min_bytes=3), folder).collect()
    assert {r.record_type for r in got} == {"response"}


def test_reader_parses_zip64_and_comments():
    a = w.ArchiveWriter()
    for i in range(5):
        a.add(i, f"http://{i}", b"x" * i, None)
    data = a.close()
    assert zipfile.ZipFile(io.BytesIO(data)).namelist() == [w.WARC, w.INDEX, w.PACKAGE]
    out = io.BytesIO(data)
    with zipfile.ZipFile(out, "a") as z:
        z.comment = b"PK\x05\x06 not the end"
    for raw in (data, out.getvalue()):
        reads = []

        def read_at(at, size, raw=raw, reads=reads):
            reads.append(size)
            return raw[at : at + size]

        r = w.ArchiveReader(read_at, len(raw))
        assert [r.record(e)[2] for e in r.entries()] == [b"x" * i for i in range(5)]
    big = io.BytesIO()
    with zipfile.ZipFile(big, "w") as z:
        for i in range(66_000):  # more entries than the plain end record can count
            z.writestr(f"m{i}", b"")
        z.writestr("last", b"end")
    raw = big.getvalue()
    r = w.ArchiveReader(lambda at, size: raw[at : at + size], len(raw))
    assert len(r.members) == 66_001 and r.range("last", 0, 3) == b"end"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"a" * 1000)
    with pytest.raises(ValueError, match="not stored"):
        w.ArchiveReader(lambda at, size: packed.getvalue()[at : at + size], len(packed.getvalue()))
