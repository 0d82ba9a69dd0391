"""Whole-text encoding with the ``tokenizers`` library.

Texts are cut where the tokenizer itself never merges: at white space, and
before punctuation that follows a letter or digit.  The blocks of many texts
are found and told apart as whole arrays; each distinct block is encoded once
per worker, so the result equals encoding the whole text while a frequent word
costs no more than its place in an array.

Literals of added tokens such as ``<|endoftext|>`` get their own id, as the
library does by default; what stands between them is cut by itself.  Texts with
such literals, or with white space beyond ASCII, are cut by a pattern instead.
"""

from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Unicode White_Space beyond ASCII, which the tokenizers' ``\s`` includes (Python's adds U+001C..1F).
FAR_SPACE = "\x85\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SPACE = f"\\t-\\r {FAR_SPACE}"
FAR = re.compile(f"[{FAR_SPACE}]")
#: Plain words: ASCII and Latin-1 letters.
WORD = "[A-Za-z\\u00c0-\\u00d6\\u00d8-\\u00f6\\u00f8-\\u00ff]++"
WORD_BYTES = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+"
END = "(?![^ \\n\\t.,;:!?])"
#: Blocks of byte-level BPE: a space belongs to what follows it.
BYTE_LEVEL = re.compile(f" ?{WORD}{END}| ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: Blocks of BPE that drops white space.
WORD_LEVEL = re.compile(f"{WORD}{END}|[^ \\n\\t\\r]+")
#: Distinct blocks that a worker remembers before it starts anew (a third of a kilobyte each), and the longest of them.
CACHE_BLOCKS = 120_000
CACHE_BYTES = 256
#: Texts encoded at once; the more, the fewer of their blocks are new to each other.
SLICE_BYTES = 2 << 20
#: Other new blocks that are encoded at once.
TOGETHER = 2048

#: Stands between texts; no byte of UTF-8.
GAP = b"\xff"
BLANK, WHITE, BORDER, ALNUM, MARK = 1, 2, 3, 4, 5
KINDS = np.zeros(256, "u1")
KINDS[33:127] = MARK
KINDS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = ALNUM
KINDS[9:14] = WHITE
KINDS[32] = BLANK
KINDS[255] = BORDER


def starts(data: np.ndarray, byte_level: bool) -> np.ndarray:
    """Where blocks begin in texts that have a border before and after each."""
    kind = KINDS[data]
    white = (kind == BLANK) | (kind == WHITE)
    border = kind == BORDER
    other = ~(white | border)
    first = border.copy()
    first[1:] |= border[:-1]
    first[1:] |= white[1:] & ~white[:-1]
    if byte_level:
        # the last of a run goes with the word behind it if it is a space, else it stands alone
        first[:-1] |= white[:-1] & other[1:]
        first[1:] |= other[1:] & (kind[:-1] == WHITE)
    else:
        first[1:] |= other[1:] & white[:-1]
    letter = kind == ALNUM
    # the second byte of a Latin-1 letter
    letter[1:] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    first[1:] |= (kind[1:] == MARK) & letter[:-1]
    return np.flatnonzero(first)


def values(a: pa.LargeBinaryArray) -> list[bytes]:
    """What ``to_pylist`` gives, cut from the buffer at once."""
    _, at, data = a.buffers()
    edges, data = np.frombuffer(at, "i8", len(a) + 1).tolist(), data.to_pybytes()
    return [data[x:y] for x, y in zip(edges, edges[1:], strict=False)]


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: itself if it is printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Encodes texts; ids come as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, byte_level: bool, cache_blocks: int = CACHE_BLOCKS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        self.model = t.model
        if hasattr(t.model, "_resize_cache"):
            t.model._resize_cache(0)  # each block comes once; the library's own cache only costs
        self.blocks = (BYTE_LEVEL if byte_level else WORD_LEVEL).findall
        added = t.get_added_tokens_decoder()
        if any(a.normalized or a.single_word or a.lstrip or a.rstrip for a in added.values()):
            raise ValueError("added tokens that are not plain literals")
        self.added = {a.content: array("I", [i]).tobytes() for i, a in added.items()}
        literals = "|".join(re.escape(w) for w in sorted(self.added, key=lambda w: (-len(w), w)))
        self.literals = re.compile(f"({literals})").split if literals else None
        self.plain = re.compile((b" ?" if byte_level else b"") + WORD_BYTES).fullmatch
        self.letters = byte_letters()
        self.byte_level = byte_level
        self.cache: dict[bytes, bytes] = {}
        self.cache_blocks = cache_blocks
        sample = [" the", "The", "Straße", " été", "xqzjkÿ", "A"] if byte_level else ["the", "The", "Straße", "ÉTÉ", "xqzjkÿ", "A"]
        spelled = self._spelled([w.encode() for w in sample])
        self.direct = [[x.id for x in self.model.tokenize(w)] for w in spelled] == [t.encode(w, add_special_tokens=False).ids for w in sample]

    def _spelled(self, words: list[bytes]) -> list[str]:
        """Plain words as the model has them, after the tokenizer's normalizer and pre-tokenizer."""
        lines = b"\n".join(words)
        if not self.byte_level:
            lines = lines.decode().lower().encode()
        return lines.decode("latin-1").translate(self.letters).split(self.letters[10])

    def _learn(self, new: list[bytes]) -> None:
        cache, tokenize = self.cache, self.model.tokenize
        words = list(filter(self.plain, new)) if self.direct else []
        if words:
            for b, spelled in zip(words, self._spelled(words), strict=True):
                cache[b] = array("I", [x.id for x in tokenize(spelled)]).tobytes()
        rest = [b for b in new if b not in cache] if len(words) < len(new) else []
        for i in range(0, len(rest), TOGETHER):
            part = rest[i : i + TOGETHER]
            for b, e in zip(part, self.tokenizer.encode_batch_fast([b.decode() for b in part], add_special_tokens=False), strict=True):
                cache[b] = array("I", e.ids).tobytes()

    def _ready(self, keys: list[bytes]) -> None:
        """Every one of these blocks in the cache; long ones stay until the next call only."""
        cache = self.cache
        if not cache or len(cache) > self.cache_blocks:
            cache.clear()
            cache.update({k.encode(): v for k, v in self.added.items()})
            cache[GAP] = b""
        self._learn([k for k in keys if k not in cache])

    def _forget(self, keys: list[bytes]) -> None:
        if max(map(len, keys), default=0) > CACHE_BYTES:
            for k in keys:
                if len(k) > CACHE_BYTES:
                    self.cache.pop(k, None)

    def odd(self, text: str) -> bool:
        return any(w in text for w in self.added) or not text.isascii() and FAR.search(text) is not None

    def cut(self, text: str) -> list[str]:
        """Blocks by pattern, for texts with added tokens or white space beyond ASCII."""
        if self.literals is None or not any(w in text for w in self.added):
            return self.blocks(text)
        out: list[str] = []
        for i, part in enumerate(self.literals(text)):
            out += [part] if i % 2 else self.blocks(part)
        return out

    def encode_odd(self, text: str) -> bytes:
        keys = [b.encode() for b in self.cut(text)]
        self._ready(list(dict.fromkeys(keys)))
        out = b"".join(map(self.cache.__getitem__, keys))
        self._forget(keys)
        return out

    def encode_all(self, texts: list) -> list[bytes]:
        """Ids of each text; a null one has none."""
        odd = {i for i, t in enumerate(texts) if t and self.odd(t)}
        plain = [t.encode() if t and i not in odd else b"" for i, t in enumerate(texts)]
        data = GAP.join([b"", *plain, b""])
        at = starts(np.frombuffer(data, "u1"), self.byte_level)
        stops = np.append(at, len(data)).astype("i8")
        block = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(stops), pa.py_buffer(data)]).dictionary_encode()
        keys, which = values(block.dictionary), block.indices.to_numpy()
        self._ready(keys)
        found = list(map(self.cache.__getitem__, keys))
        self._forget(keys)
        size = np.fromiter(map(len, found), "i8", len(found)) // 4
        n = size[which]
        end = np.cumsum(n)
        ids = np.frombuffer(b"".join(found), "<u4")
        ids = ids[np.repeat((np.cumsum(size) - size)[which] - (end - n), n) + np.arange(end[-1])]
        raw, edges = ids.tobytes(), (end[which == 0] * 4).tolist()  # the first block is a border
        out = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        for i in odd:
            out[i] = self.encode_odd(texts[i])
        return out


@lru_cache(maxsize=4)
def encoder(path: str, byte_level: bool) -> Encoder:
    """One encoder for each tokenizer file in a worker process."""
    return Encoder(path, byte_level)


def tokenizer_path(name: str) -> str:
    """Resolved where it runs: each worker has the tokenizer files installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
