"""From raw documents to training shards: five stages, each on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared
checkpoint folder and read again as the next stage's input, so a lost executor costs one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlens.llm import decontam, minhash, mixing, quality_rules, sharding
from wardlens.llm.common import read_table, store, where_computed
from wardlens.session import WRITTEN, release

#: Rules learned from labels, signatures and hash thresholds have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base checks nor a learned rule rejects."""
    rules = quality_rules.learn_rules(quality_rules.training_rows(docs, read_table(spark, sf_dir, "labels")))
    return where_computed(quality_rules.apply_rules(docs, rules), F.col("kept")).select(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest doc_id."""
    return minhash.drop_near_duplicates(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of the benchmark."""
    return decontam.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often (0, 1 or 2 times) as the mix takes them."""
    out = mixing.mix(docs).where("times > 0")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).drop("time")


def shard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and place in it."""
    return sharding.shard(docs)


STAGES = [("quality_rules", quality_stage), ("near_dedup", near_dedup_stage), ("decontaminate", decontaminate_stage),
          ("mix_sources", mix_stage), ("shard", shard_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What else the stages wrote is removed as soon as the next one's input is written."""
    docs, first = read_table(spark, sf_dir, "documents"), len(WRITTEN)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), name)
        release(spark, first, -1)
    return docs
