"""Registered queries of the training-data operators, each over its whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import (conversation_repair, decontam, filter_audit, lang_id, license_scan, line_dedup, minhash, mixing, quality_classifier,
                          quality_rules, sharding, suffix_dedup, token_counts)
from wardlens.llm.common import crc_mod, read_table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffix_dedup.dedup_substrings(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = token_counts.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), limit=2048)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").where(crc_mod(F.col("doc_id"), 3) != 1)
    ranker = quality_classifier.train(docs, labels)
    held = docs.withColumn("held_out", crc_mod(F.col("doc_id"), 3) == 1)
    return quality_classifier.score(held, ranker).select("doc_id", "held_out", "score", "predicted")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = quality_rules.learn_rules(quality_rules.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return quality_rules.apply_rules(docs, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, search="simhash").select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, columns=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op8_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return sharding.shard(docs, columns=["doc_id"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = lang_id.train(docs.where(crc_mod(F.col("doc_id"), 4) != 2))
    held = docs.select("doc_id", "text", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"))
    return lang_id.identify(held, model).select("doc_id", "held_out", "lang_pred", "score")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.mark(docs, read_table(spark, sf_dir, "benchmark")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return filter_audit.audit(docs, read_table(spark, sf_dir, "labels"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(read_table(spark, sf_dir, "conversations"))
    return conversation_repair.repair(damaged, present=F.col("present"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return license_scan.scan(docs, license_scan.build_index(docs)).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_minhash_dedup, op3_token_counts, op4_quality_classifier, op5_quality_rules,
                                   op6_line_dedup, op7_mix_sources, op8_shard, op9_language_id, op10_decontaminate,
                                   op11_filter_audit, op12_conversation_repair, op13_license_scan)}
ORACLE = {"op7_mix_sources": mixing.MIX_SQL, "op10_decontaminate": decontam.MARK_SQL, "op11_filter_audit": filter_audit.AUDIT_SQL}
