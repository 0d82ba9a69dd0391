"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags.  The first pass classifies each
block from what it is by itself: where it stands (menus, headers, footers,
sidebars, notices, adverts, forms and reader comments are out; an article
element speaks for what it holds), its length, its link density and its density
of stop words.  Short or doubtful blocks stay open, and the second pass gives
them the label of their nearest decided neighbours.  A short block in one element with main text is main text too, and a page
without any long block keeps all that is not links.
"""

from __future__ import annotations

import html
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_batches

# Frequent function words of the languages served.
STOP_WORDS = {
    "en": "a about after all also an and any are as at be because been but by can could do for from had has have he her his how i if in into is it its just more my no not of on one only or other our out she so some than that the their them then there these they this to up was we were what when which who will with would you your",
    "de": "aber alle als am an auch auf aus bei bin bis das dass dem den der des die diese doch durch ein eine einem einen einer er es für hat hatte ich ihr im in ist ja kann man mehr mein mit nach nicht noch nur oder sein sich sie sind so über um und uns unter vom von vor war was wenn wer wie wir wird zu zum zur",
    "fr": "à au aux avec ce cette ces comme dans de des du elle en est et eux fait il ils je la le les leur lui ma mais me mes même moi mon ne nos notre nous on ont ou par pas plus pour qu que qui sa sans se ses si son sont sur ta te tes toi ton tout tu un une vos votre vous y",
    "es": "a al algo como con cuando de del desde donde el ella ellos en entre era es esta este esto ha hay hasta la las le les lo los más me mi muy nada ni no nos o para pero por porque qué que quien se ser si sin sobre son su sus también te todo tu un una uno y ya yo",
}
# Elements whose text never belongs to an article.
OUT_TAGS = frozenset("nav footer aside form script style noscript template head title button select option textarea iframe object svg annotation annotation-xml canvas audio video dialog menu datalist input fieldset".split())
RAW_TAGS = frozenset("script style textarea title noscript template iframe svg".split())
# Words of class and id attributes and of roles that name such parts.
OUT_WORDS = frozenset(
    "ad ads adsbygoogle adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion nav navbar navigation menu menubar submenu topbar breadcrumb breadcrumbs sidebar aside rail footer masthead cookie cookies consent gdpr ccpa notice notices notification alert popup modal overlay disclaimer newsletter subscribe subscription signup signin login register paywall share sharing social related recommended recommendations trending popular comment comments commentlist disqus reply replies respond responses discussion feedback pagination pager toolbar search searchbox widget widgets skip hidden contentinfo complementary alertdialog".split()
)
# Those of them that name what readers write and nothing else; however long, it is no article.
READER_WORDS = frozenset("comment comments commentlist disqus reply replies respond".split())
# Words that an article's own section may have for a name as well.
TOPIC_WORDS = frozenset("responses discussion feedback".split())
# Words that say nothing of what a part holds, so that the others of its name tell it all.
PLAIN_WORDS = frozenset("area areas bar block body box button buttons card container count form frame group holder icon icons inner item items left link links list main outer panel post reader right section side slot strip thread title top unit user users wrap wrapper zone bottom".split())
# Words that make a name tell of a page's layout, not of a part of it.
LAYOUT_WORDS = frozenset("no not non has have with without is layout enabled disabled enable disable active inactive open closed js page template theme site wrapper wrap outer container col row grid result results single".split())
HEAD_WORDS = frozenset("header siteheader pageheader topheader".split())
KEPT_WORDS = frozenset("article articlebody content main post story entry".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form address details summary hr fieldset center dir menu hgroup search dialog legend".split()
)
#: Elements that are closed by what follows them, so they never hold the rest of a page.
LOOSE_TAGS = frozenset("p li dt dd tr td th thead tbody tfoot option colgroup".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<(?:!--(?:>|->|(?:.*?--!?>|.*))|(?:[!?]|/(?![a-zA-Z]))[^>]*>?|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>?)", re.S)
#: Every attribute in turn, so that a value which looks like one is never taken for it.
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]*")
RAW_END = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW_TAGS}


#: How far a name rules a part out: not at all, its blocks that look like it, unless it holds most of the page's text, or for good.
IN, WEAK, SOFT, OUT = 0, 1, 2, 3
#: Scripts without blanks between words; a character says as much as some 2.5 letters.
DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")


def length(text: str) -> int:
    """Characters, those of dense scripts counted as 2.5."""
    return len(text) if text.isascii() else len(text) + 3 * len(DENSE.findall(text)) // 2


class Rules:
    def __init__(self, short: int = 70, long: int = 200, link: float = 0.33, low: float = 0.30, high: float = 0.32, served: float = 0.12):
        self.short, self.long, self.link, self.low, self.high, self.served = short, long, link, low, high, served
        self.stops = frozenset(w for words in STOP_WORDS.values() for w in words.split())


def standing(tag: str, attributes: str, within: bool) -> tuple[int, bool]:
    """How far an element is ruled out of the article, and whether it is one; ``within``: it stands in one."""
    if tag in OUT_TAGS or tag == "header" and not within:
        return OUT, False
    if not attributes or tag in ("html", "body", "article", "main"):
        return IN, tag in ("article", "main")
    holds, gone = False, IN
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return OUT, False
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return OUT, False
        elif name in ("class", "id", "role", "itemprop"):
            for token in value.split():
                words = {w.lower() for w in PARTS.findall(token)}
                if words & OUT_WORDS and not words & LAYOUT_WORDS:
                    whole = words <= (OUT_WORDS - TOPIC_WORDS) | PLAIN_WORDS
                    if name == "role" or whole and words & READER_WORDS:
                        return OUT, False
                    # in an article, one word of a longer name is as often what the part is about
                    gone = max(gone, WEAK if within and not whole else SOFT)
                elif token.lower() in HEAD_WORDS and not within:
                    gone = max(gone, SOFT)
                holds = holds or tag in ("div", "section", "td") and (bool(words & KEPT_WORDS) or token.lower() in KEPT_WORDS)
    return gone, holds and gone == IN


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, int]]:
    """``(text, characters in links, out, in an article, heading, weak, holder)`` in page order.

    ``out`` is -1 for a part that is out for good, 0 for one that is not, else
    the number of the outermost part that a name rules out.  ``weak`` says that a
    name speaks against the block, ``holder`` is the number of the element around it.
    """
    found = []
    stack: list[tuple[str, int, bool, bool, int]] = []  # tag, out, article, weak, number
    opened: dict[str, int] = {}  # elements of the stack by tag, so that a stray end is not looked for
    out = parts = holder = holders = 0
    article = heading = weak = False
    links = link_chars = 0
    text: list[str] = []
    at = 0

    def flush():
        nonlocal link_chars
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                found.append((joined, link_chars, out, article, heading, weak, holder))
            text.clear()
        link_chars = 0

    n = len(page)
    while at < n:
        m = TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            piece = page[at:stop]
            text.append(piece)
            if links:
                link_chars += len(piece.strip())
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK_TAGS:
                flush()
            if opened.get(tag):
                flush()
                while True:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                _, out, article, weak, holder = stack[-1] if stack else ("", 0, False, False, 0)
            if tag in HEADINGS:
                heading = False
            continue
        attributes = m[3] or m[6] or ""
        if tag in RAW_TAGS:
            end = RAW_END[tag].search(page, at)
            if tag != "svg" or not attributes.endswith("/"):  # elsewhere the slash means nothing
                at = end.start() if end else n
                close = page.find(">", at)
                at = close + 1 if close >= 0 else n
            continue
        if tag == "br":
            text.append(" ")
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                flush()
            continue
        if tag == "a":
            links = 1
        if tag in BLOCK_TAGS:
            flush()
        if tag in HEADINGS:
            heading = True
        odd, holds = standing(tag, attributes, article)
        gone = -1 if odd == OUT else out
        if odd == SOFT and not out:
            parts += 1
            gone = parts
        if gone != out and tag not in BLOCK_TAGS:
            flush()
        doubt = weak or odd == WEAK
        if tag in LOOSE_TAGS and gone == out and doubt == weak:
            continue
        if tag in BLOCK_TAGS or tag in OUT_TAGS or gone != out or doubt != weak:
            holders += 1
            out, article, weak, holder = gone, article or holds, doubt, holders
            stack.append((tag, out, article, weak, holder))
            opened[tag] = opened.get(tag, 0) + 1
    flush()
    return found


def main_text(page: str | None, rules: Rules) -> str:
    """Blocks that are judged main text, joined by one space."""
    if not page:
        return ""
    found = blocks(page)
    back = outweighing(found, rules)
    kept = [b for b in found if b[2] in (0, back)]
    told = any(b[3] for b in kept)
    stops = [stop_words(b[0], rules) for b in kept]
    # an article element divides the page: what stands beside it is decided against
    free = [s for b, s in zip(kept, stops, strict=True) if (b[3] or not told) and b[1] <= rules.link * len(b[0])]
    # a page that hardly uses the listed stop words is in a language without a list: length and links alone decide
    served = sum(s[0] for s in free) >= rules.served * sum(s[1] for s in free)
    labels: list[bool | str] = []
    for (text, link_chars, _, article, heading, weak, _), (hits, words) in zip(kept, stops, strict=True):
        size = length(text)
        density = link_chars / len(text)
        stop = hits / words if served else rules.high
        if told and not article:
            labels.append(False)
        elif weak and (density > rules.link or size < rules.short or stop < rules.low):
            labels.append(False)
        elif article:
            if density > rules.link and size < rules.long:
                labels.append("short")
            else:
                labels.append(True if size >= rules.short or stop >= rules.low else "near")
        elif density > rules.link:
            labels.append(False)
        elif size < rules.short:
            labels.append(False if link_chars else "near" if heading else "short")
        elif stop >= rules.high:
            labels.append(True if size > rules.long else "near")
        else:
            labels.append("near" if stop >= rules.low else False)
    if not told and True not in labels:
        # a page of short blocks only: all that is not links
        labels = [b[1] <= rules.link * len(b[0]) for b in kept]
    main = beside(labels, settle(labels, [b[3] for b in kept]), [b[6] for b in kept])
    return " ".join(b[0] for b, x in zip(kept, main, strict=True) if x)


def beside(labels: list, main: list[bool], holders: list[int]) -> list[bool]:
    """Short blocks in one element with main text next to them are main text as well."""
    out = list(main)
    for order in (range(1, len(out)), range(len(out) - 2, -1, -1)):
        for i in order:
            last = i - 1 if order.step > 0 else i + 1
            if labels[i] == "short" and not out[i] and out[last] and holders[i] == holders[last]:
                out[i] = True
    return out


def stop_words(text: str, rules: Rules) -> tuple[int, int]:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'") in rules.stops for w in words), len(words)


def outweighing(found: list[tuple], rules: Rules) -> int:
    """The part that a name rules out although it holds an article or most of the long link-free text; 0 for none."""
    weight: dict[int, int] = {}
    for text, link_chars, out, *_ in found:
        size = length(text)
        if out >= 0 and link_chars <= rules.link * len(text) and size > rules.long:
            weight[out] = weight.get(out, 0) + size
    if not weight:
        return 0
    most = max(weight, key=lambda k: (weight[k], -k))
    return most if most and 2 * weight[most] > sum(weight.values()) and not any(b[3] and b[2] == 0 for b in found) else 0


def settle(labels: list, article: list[bool]) -> list[bool]:
    """Second pass: open labels from the nearest decided ones before and after.

    Where they differ, a ``near`` block is main text and a ``short`` one is not.
    Inside an article only the article's own blocks are asked, and one without
    decided blocks is main text.
    """
    n = len(labels)
    before: list = [None] * n
    after: list = [None] * n
    for order, side in ((range(n), before), (range(n - 1, -1, -1), after)):
        last: dict[bool, bool | None] = {True: None, False: None}
        for i in order:
            side[i] = last[article[i]]
            if isinstance(labels[i], bool):
                last[article[i]] = labels[i]
    out = []
    for x, a, b, art in zip(labels, before, after, article, strict=True):
        if isinstance(x, bool):
            out.append(x)
            continue
        known = {v for v in (a, b) if v is not None}
        if len(known) == 1 and (None not in (a, b) or art):
            out.append(known.pop())
        elif not known:
            out.append(art or x == "near")
        elif len(known) == 2:
            out.append(x == "near")
        else:
            out.append(known.pop() and x == "near")
    return out


SCHEMA = T.StructType(
    [
        T.StructField("page_id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def extract(pages: DataFrame, short: int = 70, long: int = 200, link: float = 0.33, low: float = 0.30, high: float = 0.32) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``.

    Null, empty or textless html gives an empty text.  Each row stands for
    itself, so repeated rows and null ids stay as they are; other columns are
    ignored; no rows give no rows.  A page of any length or depth is one pass of its text.
    """

    def run(rows, rules):
        texts = [main_text(h, rules) for h in rows["html"]]
        return {"page_id": rows["page_id"], "url": rows["url"], "text": texts, "n_chars": [len(t) for t in texts]}

    cols = pages.select(F.col("html").cast("string"), F.col("page_id").cast("long"), F.col("url").cast("string"))
    return map_batches(cols, run, SCHEMA, setup=lambda: Rules(short, long, link, low, high))
