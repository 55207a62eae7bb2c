"""Sharding by proportional stratified interleaving, with DataFrame functions only.

Rows of a source are shuffled by a seeded hash and ranked; (rank + offset) / count is the row's place in
[0, 1) within its source. The offset in [0, 1) is a hash of the source, so that rows of tiny sources spread over the places too. All rows in the order of this place form a stream in which any stretch
has the mixture of the whole, and the stream is cut into equal counts.

Neither rank needs all rows of a key in one task: rows are dealt by a prefix of the ordering value
(uniform by construction), counted per bucket, and ranked within a bucket; bucket counts are summed
to offsets on a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from wardlens.llm.common import hash60, n_bytes, other_columns_aside, own_name, store

#: Rows aimed at per ranking bucket.
BUCKET_ROWS = 20_000
RESULT = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")


def _rank(df: DataFrame, key: list[str], bucket: Column, order: list[Column], out: str, total: str) -> DataFrame:
    """0-based rank within ``key`` by (bucket, order) and the key's row count.

    ``bucket`` must not decrease in the wanted order and spread a key's rows evenly.
    """
    b = own_name(df, "b_")
    d = df.withColumn(b, bucket)
    counts = d.groupBy(*key, b).agg(F.count(F.lit(1)).alias("n_"))
    run = W.partitionBy(*key).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"{k}__k") for k in key], F.col(b).alias("b__k"),
                           F.coalesce(F.sum("n_").over(run), F.lit(0)).alias("off_"), F.sum("n_").over(W.partitionBy(*key)).alias(total))
    d = d.withColumn("rn_", F.row_number().over(W.partitionBy(*key, b).orderBy(*order)))
    on = F.col(b) == F.col("b__k")
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"{k}__k"))
    return d.join(counts, on).withColumn(out, F.col("rn_") - 1 + F.col("off_")).drop(b, "rn_", "off_", "b__k", *[f"{k}__k" for k in key])


@other_columns_aside(*RESULT)
def shard(df: DataFrame, shards: int = 16, seed: int = 11, source: str = "source", key: str = "doc_id",
          text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (or ``columns`` of it) with size, text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``: counts of shards differ by one at most, and so do, up to rounding, the counts of each
    source. slot numbers a shard's rows from 0 without gaps. grown_shard is null (it belongs
    to sharding by key). Null is a source of its own; null and empty texts have size 1 and the
    checksum of the empty string; rows with equal keys are told apart by their content, and wholly
    equal rows are interchangeable. Clashing result columns are replaced. An empty table gives no rows.
    """
    keep = [c for c in (columns or df.columns) if c.lower() not in RESULT]
    body = F.coalesce(df[text], F.lit(""))
    d = df.select(*[df[c] for c in keep], (n_bytes(df[text]) + 1).alias("size"), F.crc32(body).alias("text_crc32"),
                  hash60(df[key], seed=seed).alias("h__"), df[source].alias("s__"), df[key].cast("string").alias("k__"))
    if columns:  # narrow rows are written once; whole ones are cheaper to read again
        d = store(d, "shard")
    buckets = max(1, df.count() // BUCKET_ROWS)
    tie = [F.col("h__"), F.col("k__"), F.col("text_crc32"), F.col("size")]
    # Place within the source: buckets are equal stretches of the 60-bit hash.
    d = _rank(d, ["s__"], F.floor(F.col("h__") / F.lit(2.0**60) * buckets).cast("long"), tie, "r__", "n__")
    offset = F.shiftrightunsigned(hash60(F.col("s__"), seed=seed), 7) / F.lit(2.0**53)
    d = d.withColumn("f__", (F.col("r__") + offset) / F.col("n__"))
    # Place in the stream: a constant key, so that the offsets run over the (small) bucket counts.
    d = _rank(d.withColumn("one__", F.lit(0)), ["one__"], F.floor(F.col("f__") * buckets).cast("long"),
              [F.col("f__"), F.col("s__").asc_nulls_last(), *tie], "g__", "all__")
    d = d.withColumn("shard", F.expr(f"cast((g__ * {shards}) div all__ as int)"))
    d = d.withColumn("slot", F.expr(f"g__ - ((shard * all__ + {shards - 1}) div {shards})").cast("long"))
    return d.select(*keep, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
