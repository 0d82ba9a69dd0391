"""The queries of the operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, divergence, hard_negatives, html_extract, langid, multiprobe, neardup, oracles, packing, quality, secrets, token_store, warc_zip
from .common import new_folder, read


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(read(spark, sf_dir, "pages"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest, folder = token_store.store_tokens(read(spark, sf_dir, "documents"))
    return token_store.read_shards(manifest, folder)


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(decontam.scan(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.train(langid.sample(docs)))
    held = F.coalesce(langid.remainder() == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    return warc_zip.read_archives(warc_zip.write_archives(read(spark, sf_dir, "pages"), folder), folder)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(spark, sf_dir, "documents"), width=2, percent=80)


def op9_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(chat.alternatives(read(spark, sf_dir, "conversations")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents"), min_docs=3, top_terms=200)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), "vec_id % 50 = 0")


def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiprobe.search(read(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_main_text": op1_main_text,
        "op2_token_store": op2_token_store,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_warc": op5_warc,
        "op6_quality": op6_quality,
        "op7_packing": op7_packing,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_preferences": op9_preferences,
        "op10_secrets": op10_secrets,
        "op11_source_divergence": op11_source_divergence,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_nearest_vectors": op13_nearest_vectors,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontamination": oracles.OP3,
        "op5_warc": oracles.OP5,
        "op6_quality": oracles.OP6,
        "op9_preferences": oracles.OP9,
        "op11_source_divergence": oracles.OP11,
        "op12_hard_negatives": oracles.OP12,
    }
