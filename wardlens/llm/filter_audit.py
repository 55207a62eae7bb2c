"""Interaction audit of document filters: what each filter removes in every order of all of them.

Documents are reduced to the set of filters they fail (a mask); only counts per part and mask remain. A mask's
removal at step s holds for all permutations that begin with the same s letters, which are consecutive in
lexicographic order, so their first and last Lehmer ranks bound an interval. Each mask adds its count where an interval
begins and takes it away where the interval ends; a prefix sum across the ranks gives the totals of every permutation.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import words

#: Parts whose tables are made at once by a worker (600 output rows each with five filters).
PARTS_AT_ONCE = 100
MAX_FILTERS = 7
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def rank_intervals(k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (mask, step, first rank, rank after the last): where a mask is removed, and where it fails again later.

    Ranks are those of the permutations of 0..k-1 in lexicographic order; steps count from 0.
    """
    removed, again = [], []
    for mask in range(1 << k):
        stack = [((), 0, False)]
        while stack:
            prefix, rank, gone = stack.pop()
            step = len(prefix)
            width = factorial(k - 1 - step) if step < k else 0
            for digit, x in enumerate(sorted(set(range(k)) - set(prefix))):
                first, fails = rank + digit * width, bool(mask >> x & 1)
                if fails:
                    (again if gone else removed).append((mask, step, first, first + width))
                stack.append(((*prefix, x), first, gone or fails))
    return np.array(removed, np.int64).reshape(-1, 4), np.array(again, np.int64).reshape(-1, 4)


def _over_ranks(counts: np.ndarray, intervals: np.ndarray, k: int) -> np.ndarray:
    """(part, step, rank) sums of ``counts`` (part, mask) over the intervals."""
    diff = np.zeros((len(counts), k, factorial(k) + 1), np.int64)
    mask, step, first, after = intervals.T
    for p, n in enumerate(counts):
        np.add.at(diff[p], (step, first), n[mask])
        np.subtract.at(diff[p], (step, after), n[mask])
    return np.cumsum(diff, axis=2)[:, :, :-1]


def _tables(n: np.ndarray, good: np.ndarray, toxic: np.ndarray, k: int) -> dict[str, np.ndarray]:
    """The measures as (part, rank, step) arrays, from counts (part, mask)."""
    removals, repeats = rank_intervals(k)
    letter = np.array(list(permutations(range(k))))
    removed = _over_ranks(n, removals, k)
    out = {"removed": removed, "kept": n.sum(axis=1)[:, None, None] - np.cumsum(removed, axis=1),
           "redundant": _over_ranks(n, repeats, k), "good_lost": _over_ranks(good, removals, k), "toxic_lost": _over_ranks(toxic, removals, k)}
    out = {m: a.transpose(0, 2, 1) for m, a in out.items()}
    total = np.stack([(out["removed"] * (letter == x)).sum(axis=(1, 2)) for x in range(k)], axis=1)
    out["shapley"] = total[:, letter]
    out["unique_fails"] = n[:, 1 << np.arange(k)][:, letter]
    return out


def audit_masks(counts: DataFrame, letters: str) -> DataFrame:
    """(part, filter_order, step, measures) from ``counts``: part, mask, n, good, toxic (one row per part and mask).

    Bit i of a mask stands for ``letters[i]``; letters are in ascending order. One row per part (its at most
    2^k masks) goes to a worker; an empty table gives an empty result.
    """
    k = len(letters)
    if not 1 <= k <= MAX_FILTERS or list(letters) != sorted(set(letters)):
        raise ValueError(f"letters must be 1 to {MAX_FILTERS} distinct ones in ascending order")
    rows = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("m"))
    orders = ["".join(p) for p in permutations(letters)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PARTS_AT_ONCE):
                part, masks = (b.column(c).slice(at, PARTS_AT_ONCE).to_pylist() for c in range(2))
                n, good, toxic = (np.zeros((len(part), 1 << k), np.int64) for _ in range(3))
                for p, of in enumerate(masks):
                    for m in of:
                        n[p, m["mask"]], good[p, m["mask"]], toxic[p, m["mask"]] = m["n"], m["good"], m["toxic"]
                table = _tables(n, good, toxic, k)
                size = len(orders) * k
                cols = [pa.array(np.repeat(np.array(part, object), size), pa.string()), pa.array(np.tile(np.repeat(np.array(orders, object), k), len(part)), pa.string()),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(part) * len(orders)))]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(np.ascontiguousarray(table[m]).reshape(-1)) for m in MEASURES],
                                                 names=["part", "filter_order", "step", *MEASURES])

    return rows.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{m} bigint" for m in MEASURES))


def text_filters(text: Column) -> dict[str, Column]:
    """The filters A to D: short, repetitive, many capitals, odd symbols. Null counts as empty, so it fails A alone."""
    t, w = F.coalesce(text, F.lit("")), words(text)
    # What translate leaves out are the capitals.
    capitals = F.char_length(t) - F.char_length(F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": F.size(w) < 200, "B": 100 * F.size(F.array_distinct(w)) < 50 * F.size(w), "C": 100 * capitals > 2 * F.char_length(t),
            "D": t.rlike(r"[#$%&*|]")}


def mask_counts(df: DataFrame, filters: dict[str, Column], copies: str | None, labels: DataFrame, key: str = "doc_id", text: str = "text",
                part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic): rows of ``df`` by the filters they fail; good and toxic count those that ``labels`` marks.

    ``filters`` are conditions on a row (null: not failed). ``copies``, the last letter, fails rows whose whole text (null: empty)
    also stands under a smaller key anywhere in the table; rows without a key never fail it nor make others fail. Texts are
    told apart by SHA-256. Repeated keys and repeated rows count each; a null part is the empty string. A key with several
    labels is good (toxic) if any says so. Other columns are not read.

    A row leaves its scan as key, digest, part and mask. All that follows are sums with map-side combining over
    those: a text that a third of all rows share is one row per part, mask and label before its first owner is looked up.
    """
    bits = [F.when(F.coalesce(c, F.lit(False)), 1 << i).otherwise(0) for i, c in enumerate(filters.values())]
    mask = F.lit(0)
    for b in bits:
        mask = mask + b
    rows = df.select(F.col(key).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("digest"),
                     F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), mask.cast("int").alias("mask"))
    rows = rows.groupBy("id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marked = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(flag("quality").alias("good"), flag("toxic").alias("toxic"))
    rows = rows.join(marked, "id", "left").fillna(0, ["good", "toxic"])
    group = ["part", "mask", "good", "toxic"]
    if copies:
        # Within a group every key stands once, so the smallest key's count is the number of rows it may keep.
        lone = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
        g = rows.groupBy("digest", *group).agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("keyless"), lone.alias("low"))
        first = g.groupBy("digest").agg(F.min("low.id").alias("owner"))
        free = F.col("keyless") + F.when(F.col("low.id") == F.col("owner"), F.col("low.n")).otherwise(0)
        g = g.join(first, "digest").withColumn("free", free)
        bit = 1 << len(filters)
        rows = g.select("part", "good", "toxic", F.inline(F.array(F.struct("mask", F.col("free").alias("n")), F.struct(
            (F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("free")).alias("n"))))).where("n > 0")
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def audit(df: DataFrame, labels: DataFrame, filters: dict[str, Column] | None = None, copies: str | None = "E", key: str = "doc_id",
          text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the filters and step, with kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    See ``mask_counts`` for nulls, ties, repeated rows and the filter ``copies``; by default the filters are ``text_filters``.
    An empty table gives no rows; empty and very long texts are judged as they are.
    """
    chosen = text_filters(F.col(text)) if filters is None else filters
    return audit_masks(mask_counts(df, chosen, copies, labels, key, text, part), "".join(chosen) + (copies or ""))


#: The same rows in DuckDB: every mask against every order and step.
AUDIT_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT doc_id, part, concat(
        CASE WHEN len(w) < 200 THEN 'A' END, CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' END,
        CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END, CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
        CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 'E' END) AS mask FROM d),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order FROM x a, x b, x c, x d, x e
      WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS letter, left(filter_order, step - 1) AS before FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step, letter, mask, n, good, toxic, contains(mask, letter) AS fails, translate(mask, before, '') <> mask AS gone FROM s, m),
t AS (SELECT part, filter_order, step::INTEGER AS step, letter,
        sum(CASE WHEN NOT fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN fails AND NOT gone THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN fails AND gone THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN mask = letter THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN fails AND NOT gone THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN fails AND NOT gone THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, letter)::BIGINT AS shapley FROM t
"""
