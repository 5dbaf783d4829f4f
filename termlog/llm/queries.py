"""The registered queries opN_<name>: thin wrappers that give each operator its table and its contract's columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, langid, licenses, line_dedup, ngram_join, packing, passages, quality, suffix_dedup, token_counts

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from labelled rows outside the held-out quarter; a bounded model, whatever the corpus size."""
    return langid.fit(docs.where(~langid.held_out()))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "langs")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_shared_windows: over 0 where a text shares a run of over 50 words with another, which
    may be shorter than 400 bytes and then isn't removed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shared = passages.shared_passages(docs.select(F.xxhash64("doc_id", "text").alias("id"), "text"))
    removed = suffix_dedup.remove_repeats(docs)
    of = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("id")).join(shared, "id").groupBy("doc_id").agg(F.max("n_shared_windows").alias("n_shared_windows"))
    return removed.join(of, "doc_id", "left").withColumn("n_shared_windows", F.coalesce("n_shared_windows", F.lit(0).cast("bigint")))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recovery(table(spark, sf_dir, "conversations"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("key")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_line_dedup": op3_line_dedup,
        "op4_quality_rules": op4_quality_rules,
        "op5_ngram_join": op5_ngram_join,
        "op6_license_scans": op6_license_scans,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_decontamination": op10_decontamination,
        "op8_best_fit_packing": op8_best_fit_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.ORACLE.format(docs="documents")}
