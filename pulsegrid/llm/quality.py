"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histograms over character classes and over common words are
compared with those of its language by Jensen-Shannon distance (base 2, so from
0 to 1).  The references are sums over all documents of a language that pass
the base rules.  Languages without a list of common words take those of their
own documents.  A histogram is judged only from a minimum of characters or
words on, since a short text strays by chance.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

# The commonest function words of the languages served.
COMMON_WORDS = {
    "en": "the of and to in is was that for it with as on be at by this have from or are an",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un une du que est pour qui dans par sur pas au plus il",
    "es": "de la que el en y a los del se las por un para con no una su al es lo",
}
WORDS = sorted({w for words in COMMON_WORDS.values() for w in words.split()})
#: One character for each common word, from a range that texts' own words never reach here.
CODES = [chr(0x4E00 + i) for i in range(len(WORDS))]
CHAR_CLASSES = ("lower", "space", "upper", "digit", "other", "symbol", "punctuation")
#: Common words of a language without a list, by corpus counts.
OWN_WORDS = 24
#: Languages without a list whose references may be sent to every executor (about 1 kB each).
BROADCAST_LANGS = 10_000
SPACE = r"[\x20\x09-\x0D]+"


def total(array: Column | str) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda s, x: s + x)


def unlisted() -> Column:
    """Whether a row has a language, but one without a list of common words."""
    return F.col("lang").isNotNull() & ~F.col("lang").isin(list(COMMON_WORDS))


def measures(docs: DataFrame) -> DataFrame:
    """Base counts and both histograms for each row of ``docs(doc_id, text, lang)``."""
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    # each pattern runs over what the ones before left
    d = d.withColumn("r1", F.regexp_replace("t", "[a-z]+", ""))
    d = d.withColumn("r2", F.regexp_replace("r1", SPACE, ""))
    d = d.withColumn("r3", F.regexp_replace("r2", "[A-Z]+", ""))
    d = d.withColumn("r4", F.regexp_replace("r3", "[0-9]+", ""))
    d = d.withColumn("r5", F.regexp_replace("r4", r"[^\x00-\x7F]+", ""))
    d = d.withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    lines = F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "")
    d = d.select(
        "doc_id",
        "lang",
        "words",
        F.when(unlisted(), F.transform("words", lambda w: F.lower(w))).alias("own_words"),
        F.size("words").cast("long").alias("n_words"),
        F.array([F.length(c) for c in ("t", "r1", "r2", "r3", "r4", "r5")]).alias("left"),
        F.regexp_count("r5", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    known = F.create_map([F.lit(x) for pair in zip(WORDS, CODES, strict=True) for x in pair])
    longest = max(map(len, WORDS))
    d = d.select(
        "doc_id",
        "lang",
        "own_words",
        "n_words",
        (F.col("left")[0] - F.col("left")[1] + F.col("left")[2]).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.array(*[(F.col("left")[i] - F.col("left")[i + 1]).cast("long") for i in range(5)], "n_symbols", (F.col("left")[5] - F.col("n_symbols")).cast("long")).alias("char_hist"),
        F.array_join(F.transform("words", lambda w: F.when(F.octet_length(w) <= longest + 1, F.element_at(known, F.lower(w)))), "").alias("codes"),
        # the windows of three words with their places, equal ones side by side
        F.sort_array(
            F.transform(
                F.slice("h", F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))),
                lambda x, i: F.struct(F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2)).alias("g"), i.alias("p")),
            )
        ).alias("s"),
    )
    word_counts = F.transform(F.lit(CODES), lambda c: (F.length("codes") - F.length(F.replace(F.col("codes"), c, F.lit("")))).cast("long"))
    twice = F.filter(
        F.transform("s", lambda x, i: F.when((F.get("s", i - 1)["g"] == x["g"]) | (F.get("s", i + 1)["g"] == x["g"]), x["p"])),
        lambda p: p.isNotNull(),
    )
    d = d.select("*", F.concat(word_counts, F.array(F.col("n_words") - F.length("codes"))).alias("word_hist"), F.sort_array(twice).alias("at")).drop("s", "codes")
    covered = F.transform("at", lambda x, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - x, F.lit(3))).cast("long"))
    return d.withColumn("n_repeat_words", total(covered)).drop("at")


def base_failed(min_words: int = 50, max_repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Histograms of each language served, as shares, over all rows that pass the base rules."""
    rows = measured.filter(F.col("lang").isin(list(COMMON_WORDS)) & ~base_failed())
    n = (len(CHAR_CLASSES), len(WORDS) + 1)
    sums = [F.sum(F.col(c)[i]).alias(f"{c}_{i}") for c, size in zip(("char_hist", "word_hist"), n, strict=True) for i in range(size)]
    out = {}
    for r in rows.groupBy("lang").agg(*sums).collect():  # a row for each language served
        chars, words = list(r[1 : 1 + n[0]]), list(r[1 + n[0] :])
        out[r["lang"]] = ([x / max(1, sum(chars)) for x in chars], [x / max(1, sum(words)) for x in words])
    return out


def own_references(rows: DataFrame) -> DataFrame:
    """``ref_lang, char_ref, own_names, word_ref`` for each language of rows without a listed one."""
    good = rows.filter(~base_failed())
    sums = [F.sum(F.col("char_hist")[i]) for i in range(len(CHAR_CLASSES))]
    chars = good.groupBy(F.col("lang").alias("ref_lang")).agg(F.array(*sums).alias("c"), F.sum("n_words").alias("n"))
    words = good.select(F.col("lang").alias("ref_lang"), F.explode("own_words").alias("w")).groupBy("ref_lang", "w").count()
    rank = F.row_number().over(Window.partitionBy("ref_lang").orderBy(F.desc("count"), "w"))
    top = words.withColumn("rank", rank).filter(F.col("rank") <= OWN_WORDS).groupBy("ref_lang").agg(F.sort_array(F.collect_list(F.struct("rank", "w", "count"))).alias("top"))
    both = chars.join(top, "ref_lang").withColumn("all", F.greatest(total("c"), F.lit(1)))
    return both.select(
        "ref_lang",
        F.transform("c", lambda x: x / F.col("all")).alias("char_ref"),
        F.col("top.w").alias("own_names"),
        F.transform(F.concat(F.col("top.count"), F.array(F.col("n") - total("top.count"))), lambda x: x / F.col("n")).alias("word_ref"),
    )


def own_distances(rows: DataFrame) -> DataFrame:
    """Rows without a listed language with both distances from their language's own references."""
    refs = stage(own_references(rows), "quality-own")
    side = F.broadcast(refs) if refs.count() <= BROADCAST_LANGS else refs
    d = rows.join(side, F.col("lang") == F.col("ref_lang"), "left")
    counts = F.transform("own_names", lambda name: F.size(F.filter("own_words", lambda w: w == name)).cast("long"))
    d = d.withColumn("own_counts", counts).withColumn("own_hist", F.concat("own_counts", F.array(F.col("n_words") - total("own_counts"))))
    out = {"char_distance": divergence("char_hist", F.col("char_hist_n"), F.col("char_ref")), "word_distance": divergence("own_hist", F.col("n_words"), F.col("word_ref"))}
    return d.withColumns(out).select(*rows.columns, *out)


def divergence(counts: str, n: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of counts, ``n`` in all, from a reference in shares; null without counts."""

    def term(x: Column, y: Column) -> Column:
        p = x / n
        m = (p + y) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    d = F.aggregate(F.zip_with(counts, reference, term), F.lit(0.0), lambda s, x: s + x) / 2
    return F.when(n > 0, F.sqrt(F.greatest(d, F.lit(0.0))))


def judge(
    docs: DataFrame,
    max_char_distance: float = 0.28,
    max_word_distance: float = 0.345,
    min_chars: int = 200,
    min_words: int = 100,
) -> DataFrame:
    """Base counts, distances and verdict for each row of ``docs``.

    A document is held against its own language.  One without a language shows
    its distances from the nearest listed one, but they don't reject it.  Null and empty texts have no words and
    fail; rows repeat as they do in ``docs``; no rows give no rows; columns
    other than ``doc_id, text, lang`` are ignored.
    """
    measured = stage(measures(docs), "quality")
    refs = references(measured)
    # sums stand in columns of their own, or each bin would add them up again
    measured = measured.withColumns({"char_hist_n": total("char_hist"), "word_hist_n": total("word_hist")})
    others = measured.filter(unlisted())
    out = measured.filter(~unlisted())
    for i, (name, counts) in enumerate((("char_distance", "char_hist"), ("word_distance", "word_hist"))):
        each = [divergence(counts, F.col(f"{counts}_n"), F.lit(refs[k][i])) for k in sorted(refs)]
        nearest = reduce(lambda a, b: F.least(a, b), each) if each else F.lit(None).cast("double")
        own = nearest
        for k, d in zip(sorted(refs), each, strict=True):
            own = F.when(F.col("lang") == k, d).otherwise(own)
        out = out.withColumn(name, own)
    if not others.isEmpty():
        out = out.unionByName(own_distances(others))
    strange = F.col("lang").isNotNull() & ((F.col("word_chars") >= min_chars) & (F.coalesce("char_distance", F.lit(0.0)) > max_char_distance) | (F.col("n_words") >= min_words) & (
        F.coalesce("word_distance", F.lit(0.0)) > max_word_distance
    ))
    return out.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        (~base_failed() & ~strange).alias("kept"),
        F.round("char_distance", 6).alias("char_distance"),
        F.round("word_distance", 6).alias("word_distance"),
    )
