"""Language identification: averaged hashed subword embeddings, linear softmax.

Subwords are the byte 2- to 4-grams of the lower-cased text with everything but
letters blanked, hashed to ``buckets``; their embeddings are averaged and fed to
a linear softmax.  Stochastic gradient descent in numpy trains both on a bounded
sample of labelled rows; a temperature fitted on the part of the sample that
training leaves out calibrates the scores, and a score under the calibrated
threshold rejects a text.

Averaging and the linear layer commute, so workers hold one row of class scores
for each bucket, and a text of any length is summed in pieces.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keep_rows, map_batches

SIZES = (2, 3, 4)
PIECE = 1 << 20
#: ASCII letters and bytes of other characters stay; the rest becomes blank.
TABLE = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(m.group().isalpha() for m in LETTER.finditer(text))


def grams(data: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each size, bucket of the n-gram at each byte and whether it counts."""
    out = []
    x = data.astype("u4")
    letter = data != 32
    for n in SIZES:
        m = len(x) - n + 1
        if m <= 0:
            out.append((np.zeros(0, "i8"), np.zeros(0, bool)))
            continue
        h = np.full(m, n, "u4")
        some = np.zeros(m, bool)
        for i in range(n):
            h = (h ^ x[i : i + m]) * np.uint32(0x01000193)
            some |= letter[i : i + m]
        h *= np.uint32(0x9E3779B1)
        out.append(((h >> np.uint32(32 - bits)).astype("i8"), some))
    return out


def blanked(text: str) -> bytes:
    return b" " + text.lower().encode().translate(TABLE) + b" "


def features(text: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their shares."""
    count = np.zeros(1 << bits, "i8")
    for bucket, some in grams(np.frombuffer(blanked(text), "u1"), bits):
        count += np.bincount(bucket[some], minlength=1 << bits)
    at = np.flatnonzero(count)
    return at, (count[at] / max(1, count.sum())).astype("f4")


@dataclass
class Model:
    langs: list[str]
    scores: np.ndarray  # buckets x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    bits: int

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def logits(self, texts: list[str]) -> np.ndarray:
        """Summed over pieces of ``PIECE`` bytes, each n-gram once."""
        out = np.zeros((len(texts), len(self.langs)))
        raw = [blanked(t) for t in texts]
        pad = b" " * (max(SIZES) - 1)
        ends = np.cumsum([len(r) + len(pad) for r in raw])
        data = pad.join([*raw, b""])
        total = np.zeros(len(texts))
        columns = [np.ascontiguousarray(self.scores[:, i]) for i in range(len(self.langs))]
        for at in range(0, len(data), PIECE):
            part = np.frombuffer(data[at : at + PIECE + max(SIZES) - 1], "u1")
            first = int(np.searchsorted(ends, at, side="right"))
            stop = int(np.searchsorted(ends, min(at + PIECE, len(data)) - 1, side="right")) + 1
            cuts = np.clip(np.concatenate([[0], ends[first:stop]]) - np.array([0] + [at] * (stop - first)), 0, PIECE)
            for n, (bucket, some) in zip(SIZES, grams(part, self.bits), strict=True):
                m = min(len(bucket), PIECE)
                bucket, some = bucket[:m], some[:m]
                c = np.minimum(cuts, m)
                total[first:stop] += np.diff(np.concatenate([[0], np.cumsum(some)])[c])
                for i, col in enumerate(columns):
                    sums = np.concatenate([[0.0], np.cumsum(np.where(some, col[bucket], 0.0))])
                    out[first:stop, i] += np.diff(sums[c])
        return out / np.maximum(total, 1)[:, None] + self.bias

    def predict(self, texts: list) -> tuple[list, list, list]:
        """Language or ``und``, calibrated score, and whether it is rejected."""
        real = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        lang, score, out = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
        if real:
            p = self.probabilities(self.logits([texts[i] for i in real]))
            for i, k, s in zip(real, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                lang[i], score[i], out[i] = self.langs[k], min(1.0, s), s < self.threshold
        return lang, score, out


def train(rows: list[tuple[str, str, bool]], bits: int = 15, dim: int = 16, updates: int = 20_000, rate: float = 0.4, reject: float = 0.001, seed: int = 3) -> Model:
    """Fit on ``(text, lang, for calibration)``; an empty sample gives a model that says und."""
    langs = sorted({r[1] for r in rows})
    k = len(langs)
    if not k:
        return Model([], np.zeros((1 << bits, 0)), np.zeros(0), 1.0, 1.0, bits)
    r = np.random.default_rng(seed)
    e = r.uniform(-1 / dim, 1 / dim, (1 << bits, dim)).astype("f4")
    w, bias = np.zeros((dim, k), "f4"), np.zeros(k, "f4")
    data = [(*features(t, bits), langs.index(lang), c) for t, lang, c in rows]
    fitted = {x[2] for x in data if not x[3] and len(x[0])}
    # a language that only calibration rows hold is learned from those
    fit = [x[:3] for x in data if len(x[0]) and (not x[3] or x[2] not in fitted)]
    steps = max(updates, 3 * len(fit)) if fit else 0
    order = np.concatenate([r.permutation(len(fit)) for _ in range(-(-steps // len(fit)))])[:steps] if fit else []
    for step, i in enumerate(order):
        at, share, y = fit[i]
        lr = np.float32(rate * (1 - step / steps))
        rows_e = e[at]
        mean = share @ rows_e
        z = mean @ w + bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        back = w @ p
        w -= lr * np.outer(mean, p)
        bias -= lr * np.float32(0.1) * p
        # shares are spread over thousands of buckets; the step is that of a mean over words
        e[at] -= (lr * np.float32(100.0)) * share[:, None] * back
    model = Model(langs, (e @ w).astype("f8"), bias.astype("f8"), 1.0, 0.0, bits)
    held = [x for x in data if x[3] and len(x[0])] or [x for x in data if len(x[0])]
    if held:
        logits = np.stack([share @ model.scores[at] + model.bias for at, share, _, _ in held])
        y = np.array([x[2] for x in held])

        def loss(t):
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]).mean())

        model.temperature = min((float(t) for t in np.geomspace(0.25, 8, 41)), key=loss)
        p = model.probabilities(logits)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(min(0.5, np.quantile(right, reject))) if len(right) else 0.0
    return model


def remainder(column: str = "doc_id") -> Column:
    return F.crc32(F.col(column).cast("string")) % 4


def sample(docs: DataFrame, per_lang: int = 800, max_chars: int = 20_000, all_chars: int = 1 << 28) -> list[tuple[str, str, bool]]:
    """Labelled rows for training: about ``per_lang`` of every language, by hash.

    The bounds are parameters: at most ``2 * per_lang`` rows of a language reach
    the driver.  A text over ``max_chars`` characters lends a window of that
    size, from a place by hash; with so many languages that ``per_lang`` such
    windows of each would pass ``all_chars``, windows are shorter, and no
    language is left out.  Rows whose remainder is 2 are never read for
    training; those with 3 serve calibration.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), place.alias("place")).filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != 2)
    )
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("first"))
    langs = counts.count()
    if not langs:
        return []
    size = max(1, min(max_chars, all_chars // (per_lang * langs)))
    # a share of the hash range that holds per_lang rows of each language, and one row at least
    most = F.greatest((F.least(F.lit(1.0), F.lit(float(per_lang)) / F.col("n")) * float(1 << 30)).cast("long"), F.col("first") + 1)
    start = F.pmod(F.xxhash64("doc_id", "lang"), F.greatest(F.length("text") - size + 1, F.lit(1)).cast("long")).cast("int") + 1
    got = rows.join(F.broadcast(counts.select("lang", most.alias("most"))), "lang").filter(F.col("place") < F.col("most"))
    got = got.select("doc_id", F.substr("text", start, F.lit(size)).alias("text"), "lang", remainder().alias("r"), "place")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    got = got.withColumn("rank", rank).filter(F.col("rank") <= 2 * per_lang).collect()
    return [(x.text, x.lang, x.r == 3) for x in sorted(got, key=lambda x: (x.doc_id, x.lang, x.text))]


PREDICTED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("rejected", T.BooleanType()),
    ]
)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` for each row of ``docs(doc_id, text)``.

    A text that is null or has no letter is ``und`` with score 0 and rejected.
    Predictions depend on the text alone, so copies agree; null ids stay null.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages numbers

    def run(rows, m):
        lang, score, out = m.predict(rows["text"])
        return {"doc_id": rows["doc_id"], "lang_pred": lang, "score": score, "rejected": out}

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PREDICTED, setup=lambda: shared.value)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all their columns.

    A model without languages can't tell: every text with a letter is kept then.
    """
    if not model.langs:
        return keep_rows(docs, lambda rows, _: [has_letter(x) for x in rows], None)
    return keep_rows(docs, lambda rows, m: [not x for x in m.predict(rows)[2]], model)
