"""Sharding of tables with very many tiny sources."""

from collections import Counter

from pyspark.sql import functions as F

from wardlens.llm import sharding

from .util import frame


def test_rows_of_tiny_sources_spread_over_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    largest, rank = [], sharding._rank

    def spy(df, key, bucket, *rest):
        largest.append(df.groupBy(bucket.alias("b"), *key).count().agg(F.max("count")).first()[0])
        return rank(df, key, bucket, *rest)

    monkeypatch.setattr(sharding, "_rank", spy)
    rows = [(k, f"t{k}", "en", f"s{k}") for k in range(2000)]
    out = sharding.shard(frame(spark, rows), shards=16).collect()
    assert largest[1] <= 100
    assert Counter(r.shard for r in out) == dict.fromkeys(range(16), 125) and len({(r.shard, r.slot) for r in out}) == 2000
