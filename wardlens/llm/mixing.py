"""Mixing sources to target weights by hash thresholds.

Every row has a uniform hash. Per source, sizes are summed by the leading hash bits; the bucket in
which the budget runs out is found on this small histogram, and only rows of that bucket are
looked at again with the next bits. The end is one threshold per source, applied as a filter. Thresholds
nest: a larger budget keeps all rows of a smaller one. Rows are never sorted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from wardlens.llm.common import hash60, n_words, other_columns_aside, own_name, store

#: Hash bits looked at per refinement, and refinements; together all 60 bits.
BITS, LEVELS = 12, 5
WEIGHTS = (3, 1, 2)


def source_targets(totals: DataFrame, weights=WEIGHTS, num: int = 3, den: int = 2, cap: int = 2) -> DataFrame:
    """Targets per source from (source, total): ``num/den`` of all sizes shared by weight.

    Sources in code-point order (null last) take the weights in turn. A target stops at
    ``cap`` times its source's size and the excess is shared again by weight: with sources in the
    order of cap / weight, the level is the first at which the next source is not full. One row per
    source, so the window runs over a small aggregate.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = totals.withColumn("w", w.cast("long")).withColumn("ratio", cap * F.col("total") / F.col("w"))
    fill = W.orderBy("ratio", F.col("source").isNull(), "source")
    before, rest = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(W.currentRow, W.unboundedFollowing)
    level = (F.lit(num) * F.sum("total").over(W.partitionBy()) - F.lit(den * cap) * F.coalesce(F.sum("total").over(before), F.lit(0))) \
        / (F.lit(den) * F.sum("w").over(rest))
    t = t.withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(W.partitionBy())["level"]
    full = (cap * F.col("total")).cast("double")
    return t.withColumn("found", found).select("source", "total", F.coalesce(F.least(full, F.col("w") * F.col("found")), full).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: whole passes over it, and the largest hash of the rows taken once more (-1: none).

    ``rows`` has (source, size, h). The budget of the last pass is target - passes * total; rows
    are taken by rising hash while this brings the sum nearer to it (equal hashes go together).
    """
    want = targets.select("source", "target", "total", F.when(F.col("total") > 0, F.least(F.lit(1.0), F.floor(F.col("target") / F.col("total"))))
                          .otherwise(0).cast("int").alias("passes"))
    want = want.withColumn("passes", F.when(F.col("target") >= 2 * F.col("total"), 2).otherwise(F.col("passes")))
    # State per source: hash prefix of the boundary bucket, and the size below that bucket.
    state = want.select("source", "target", "total", "passes", (F.col("target") - F.col("passes") * F.col("total")).alias("budget"),
                        F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"))
    for level in range(LEVELS):
        shift = 60 - BITS * (level + 1)
        if level:
            s = state.select(F.col("source").alias("s"), F.col("prefix").alias("p")).where("p >= 0")
            live = rows.join(s, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift + BITS) == F.col("p"))).drop("s", "p")
        else:
            live = rows
        hist = live.groupBy("source", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("n"))
        up = W.partitionBy("source").orderBy("b")
        hist = hist.withColumn("upto", F.sum("n").over(up)).withColumnRenamed("source", "s")
        # The boundary is the first bucket whose end passes the budget.
        st = state.drop("n").join(hist, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") >= 0), "left")
        hit = F.min(F.when(F.col("below") + F.col("upto") > F.col("budget"), F.struct("b", "n", "upto")))
        state = st.groupBy("source", "target", "total", "passes", "budget", "below").agg(hit.alias("x")).select(
            "source", "target", "total", "passes", "budget", F.coalesce("x.b", F.lit(-1)).cast("long").alias("prefix"),
            (F.col("below") + F.when(F.col("x").isNull(), F.lit(0)).otherwise(F.col("x.upto") - F.col("x.n"))).cast("long").alias("below"),
            F.coalesce("x.n", F.lit(0)).cast("long").alias("n"))
        state = store(state, "mix")
    # At the last level a bucket is one hash: it is taken if that comes nearer to the budget.
    nearer = (F.col("below") + F.col("n") - F.col("budget")) < (F.col("budget") - F.col("below"))
    cut = F.when(F.col("prefix") < 0, F.lit(2**60)).when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1)
    return state.select("source", "total", "target", F.least("passes", F.lit(2)).alias("passes"), cut.cast("long").alias("cut"))


@other_columns_aside("size", "source_size", "target", "times", "taken")
def mix(df: DataFrame, seed: int = 7, source: str = "source", key: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Rows of ``df`` (or ``columns`` of it) with size, source_size, target, times and taken.

    times (0, 1 or 2) is how often the mix holds the row and taken = size * times. Size is the
    number of words, 0 for null, empty or blank texts (such rows are kept or left by their hash like
    any other). Null is a source of its own. Rows with equal keys share a hash and so a fate; an
    empty table gives an empty result; clashing result columns are replaced.
    The narrow columns are computed from the texts once and written; only they are scanned again.
    """
    keep = [c for c in (columns or df.columns) if c.lower() not in ("size", "source_size", "target", "times", "taken")]
    h, s = own_name(df, "h_"), own_name(df, "s_")
    base = df.select(*[df[c] for c in keep], n_words(df[text]).alias("size"), hash60(df[key], seed=seed).alias(h), df[source].alias(s))
    if columns:  # narrow rows are written once and serve both passes
        base = store(base, "mix")
    rows = base.select(F.col(s).alias("source"), "size", F.col(h).alias("h"))
    if not columns:
        rows = store(rows, "mix")
    totals = rows.groupBy("source").agg(F.sum("size").alias("total"))
    cut = store(thresholds(rows, source_targets(totals)), "mix").select(
        F.col("source").alias("cut_source"), F.col("total").alias("source_size"), "target", "passes", "cut")
    out = base.join(cut, F.col(s).eqNullSafe(F.col("cut_source")), "left")
    times = F.when(F.col("passes") >= 2, 2).otherwise(F.col("passes") + (F.col(h) <= F.col("cut")).cast("int")).cast("int")
    return out.withColumn("times", times).withColumn("taken", F.col("size") * F.col("times")).select(
        *keep, "size", "source_size", "target", "times", "taken")


#: The same rows in DuckDB: cumulative sums over the hash order.
MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5('7|' || doc_id), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS total FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w FROM s),
r AS (SELECT *, 2 * total::DOUBLE / w AS ratio FROM w),
l AS (SELECT *, (3 * sum(total) OVER () - 4 * coalesce(sum(total) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
          / (2 * sum(w) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM r),
f AS (SELECT arg_min(level, ratio) AS found FROM l WHERE level <= ratio),
t AS (SELECT source, total, coalesce(least(2.0 * total::DOUBLE, w::DOUBLE * found), 2.0 * total) AS target FROM l LEFT JOIN f ON true),
p AS (SELECT *, CASE WHEN target >= 2 * total THEN 2 WHEN target >= total THEN 1 ELSE 0 END AS passes FROM t),
g AS (SELECT d.*, p.total, p.target, p.passes, p.target - p.passes * p.total::DOUBLE AS budget,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(d.size) OVER (PARTITION BY d.source, d.h) AS n
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, total AS source_size, target,
       (size * CASE WHEN passes = 2 THEN 2
                    WHEN upto <= budget OR (upto - n <= budget AND upto - budget < budget - (upto - n)) THEN passes + 1 ELSE passes END)::BIGINT AS taken
FROM g
"""
