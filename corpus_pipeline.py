"""From raw documents to packed sequences: the stages of the corpus pipeline.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is
written and read again as the next stage's ``docs``; all but the last keep the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import decontam, langid, neardup, packing, secrets
from pulsegrid.llm.common import read, stage


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the identifier does not reject; null texts and those without letters go.

    Ids decide nothing: rows with a null id or a repeated one are each judged by their own text.
    """
    model = langid.train(langid.sample(docs))
    return langid.keep_identified(docs, model)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group at five-word shingles and a similarity of 0.8.

    Rows that share a doc_id are one document, of which the row that is first by
    text and the other columns stays; rows without an id stay as they are.
    """
    found = stage(neardup.near_duplicates(docs, width=5, percent=80), "dup-found")
    gone = stage(found.filter(~F.col("kept")).select("doc_id").distinct(), "dup-gone")
    side = F.broadcast(gone) if gone.count() <= neardup.BROADCAST_IDS else gone
    kept = docs.join(side, "doc_id", "left_anti").select(*docs.columns)
    twice = stage(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "dup-twice")
    n = twice.count()
    if not n:
        return kept
    side = F.broadcast(twice) if n <= neardup.BROADCAST_IDS else twice
    row = F.struct("text", *[c for c in docs.columns if c not in ("doc_id", "text")])
    one = kept.join(side, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_row"))
    one = one.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"_row.{c}").alias(c) for c in docs.columns])
    return kept.join(side, "doc_id", "left_anti").select(*docs.columns).union(one)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item; null texts have no words and stay, each row is judged by itself."""
    return decontam.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced; rows that share an id keep their own texts, null texts and ids stay as they are."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids; a null text is the end id alone, a null id stays null, repeated rows are packed each for itself."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("decontamination", decontaminated),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: A trained model and hashed signatures decide, which SQL does not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
