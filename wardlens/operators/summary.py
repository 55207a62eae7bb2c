"""Descriptive summaries: Table One, histograms, counts (AGG-11..16, AGG-20, SRT-03, SMP-01)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardlens.session import materialize


def spine_join(frames: list[DataFrame], key: str = "encounter_id") -> DataFrame:
    """JOIN-04: the full outer join of per-encounter variables, built as a spine of all ids
    followed by left joins (a chain of full joins re-shuffles at every step). Spine and joins both read the
    frames, which are therefore written once to the shared checkpoint folder."""
    frames = [materialize(f) for f in frames]
    spine = reduce(lambda a, b: a.unionByName(b), [f.select(key) for f in frames]).distinct()
    return reduce(lambda acc, f: acc.join(f, key, "left"), frames, spine)


def table_one(t1: DataFrame, numeric, categorical, key: str = "encounter_id", group: str | None = None) -> DataFrame:
    """AGG-16: long Table One ``(group, variable, level, n, missing, mean, sd, pct)``.

    Numeric variables give n, missing, mean and sample SD; categorical ones give a count
    and a percentage of the non-missing rows per level. All variables go through one grouped aggregate, so
    ``t1`` is read once; a window over its few rows gives the totals that percentages need.
    """
    g = F.col(group).cast("string") if group else F.lit("overall")
    none = F.lit(None)
    long = [F.struct(F.lit(c).alias("variable"), none.cast("string").alias("level"), F.col(c).cast("double").alias("v"), F.lit(True).alias("_num")) for c in numeric]
    long += [F.struct(F.lit(c).alias("variable"), F.col(c).cast("string").alias("level"), none.cast("double").alias("v"), F.lit(False).alias("_num")) for c in categorical]
    rows = t1.select(g.alias("group"), F.explode(F.array(*long)).alias("_s")).select("group", "_s.*")
    num, level = F.col("_num"), F.col("level")
    agg = rows.groupBy("group", "variable", "level", "_num").agg(
        F.count(F.lit(1)).alias("_rows"), F.count("v").alias("_known"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    over = Window.partitionBy("group", "variable")
    agg = agg.withColumn("_tot", F.sum(F.when(level.isNotNull(), F.col("_rows"))).over(over)).withColumn(
        "_null", F.coalesce(F.sum(F.when(level.isNull(), F.col("_rows"))).over(over), F.lit(0)))
    return agg.where(num | level.isNotNull()).select(
        "group", "variable", "level", F.when(num, F.col("_known")).otherwise(F.col("_rows")).alias("n"),
        F.when(num, F.col("_rows") - F.col("_known")).otherwise(F.col("_null")).alias("missing"), "mean", "sd",
        F.when(~num, F.col("_rows") * 100.0 / F.col("_tot")).alias("pct"))


def histogram(df: DataFrame, col: str = "value", lo: float = 0.0, hi: float = 1.0, bins: int = 10,
              by=()) -> DataFrame:
    """AGG-20: counts per equal-width bucket (0 below ``lo``, ``bins+1`` at or above ``hi``)."""
    b = F.width_bucket(F.col(col), F.lit(lo), F.lit(hi), F.lit(bins)).alias("bucket")
    return df.where(F.col(col).isNotNull()).groupBy(*by, b).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, cols, out: str = "n") -> DataFrame:
    """AGG-11/14: rows per group."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out))


def distinct_counts(df: DataFrame, cols, value: str, out: str = "n") -> DataFrame:
    """AGG-12: distinct values of ``value`` (nulls not counted) per group.

    The rows are dealt out by group and value over all shuffle partitions first, so that no task holds the distinct rows on top of
    what the steps before have sorted there, nor more of them than its share (a count of partitions that is given is not coalesced).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.select(*cols, value).repartition(n, *cols, value).groupBy(*cols).agg(F.countDistinct(value).alias(out))


def top_counts(df: DataFrame, cols, k: int = 50) -> DataFrame:
    """SRT-03: the ``k`` most frequent groups (ties broken by the group columns)."""
    return value_counts(df, cols).orderBy(F.desc("n"), *cols).limit(k)


def sample_ids(df: DataFrame, n: int, seed: int = 42, key: str = "encounter_id") -> DataFrame:
    """SMP-01: all rows of ``n`` distinct encounters chosen by a seeded hash (deterministic).

    Only the ``n`` smallest hashes travel to one task (a top-k, bounded by ``n``).
    """
    ids = df.select(key).distinct().withColumn("_h", F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    chosen = ids.orderBy("_h", key).limit(n).select(key)
    return df.join(chosen, key, "left_semi")
