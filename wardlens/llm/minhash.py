"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

Texts become sets of five-word shingles, all of weight 1: links are set Jaccard, and only with equal weights is the
probability Jaccard similarity the same, however often the texts repeat a shingle. In ProbMinHash every shingle is a
Poisson process whose rate is its weight: its arrivals fall into random registers, each register
keeps the shingle that arrived first, and a shingle stops as soon as its next arrival is later than
the latest register. Two texts agree in a register with a probability equal to their probability Jaccard
similarity. Bands of registers give candidate groups; candidates are verified on the shingle sets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import bucket_components, other_columns_aside, store, with_ids

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at similarity 0.8 misses all bands with probability (1 - 0.8**ROWS)**BANDS, 2e-6.
ROWS, BANDS = 6, 44
#: Before the sets are fetched, the lowest bits of the first 128 registers are compared. At a similarity of 0.8, 115 agree on
#: average (deviation 3.4); pairs with fewer than so many are dropped (probability 2e-9, in large sets). In small sets few bits decide
#: how often other shingles agree by chance (6e-4 for sets of 4), so pairs with a set below BITS_FROM skip this test; from there on it is 3e-9 at most.
BITS_AGREE, BITS_FROM = 92, 64
#: Members of large buckets that are still apart compare the lowest 4 bits of 256 registers. At a similarity of 0.8, 208 agree on
#: average (deviation 6.2, agreement by chance included); fewer than so many have a probability of 3e-7, and of 4e-6 in small sets
#: where no other shingles agree by chance.
NIBBLES, NIBBLES_AGREE = 256, 175
#: Of them, members with at most so many distinct shingles carry these, and a pair of such members is told exactly where it meets:
#: in a group that is dense around the threshold most pairs are just below it, and no signature of a bounded size keeps them apart.
SET_SIZE = 256
#: Characters at which str.split() would split beyond the ASCII white space of words.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-known 64-bit finaliser: neighbouring inputs become unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """64-bit hashes of all windows of ``size`` white-space words (with repeats), as uint64.

    A text of fewer, but some, words is one shingle; no words give none.
    """
    if not text:
        return np.zeros(0, np.uint64)
    w = re.findall(r"[^\x20\x09-\x0D]+", text) if _OTHER_SPACE.search(text) else text.split()
    if not w:
        return np.zeros(0, np.uint64)
    h = pd.util.hash_array(np.array(w, dtype=object), categorize=len(w) > 50)
    size = min(size, len(w))
    n = len(w) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = _mix(out * _GOLD + h[j:j + n])
    return out


def signatures(sets: list[np.ndarray], weights: list[np.ndarray], registers: int) -> np.ndarray:
    """ProbMinHash of each non-empty weighted set: ``len(sets) x registers`` element hashes.

    All sets advance together. In each round the living elements draw their next block of
    arrivals (exponential gaps at their rate, register by hash, both functions of element and arrival number only);
    an element whose last arrival is later than its set's latest register is done.
    """
    n = len(sets)
    best = np.full(n * registers, np.inf)
    owner = np.full(n * registers, 0, np.uint64)
    item, rate = np.concatenate(sets), np.concatenate(weights)
    home = np.repeat(np.arange(n), [len(s) for s in sets])
    now, step, block = np.zeros(len(item)), 0, 1
    while len(item):
        arrival = np.arange(step, step + block, dtype=np.uint64)
        r = _mix(item[:, None] + _GOLD * (arrival[None, :] + np.uint64(1)))
        gaps = -np.log1p(-((r >> np.uint64(11)).astype(np.float64) * 2.0**-53)) / rate[:, None]
        t = now[:, None] + np.cumsum(gaps, axis=1)
        slot = (home[:, None] * registers + (_mix(r) % np.uint64(registers)).astype(np.int64)).ravel()
        flat = t.ravel()
        live = np.flatnonzero(flat < best[slot])
        # Sorted by time, latest first, so that the earliest arrival is written last.
        live = live[np.argsort(-flat[live], kind="stable")]
        best[slot[live]] = flat[live]
        owner[slot[live]] = np.repeat(item, block)[live]
        latest = best.reshape(n, registers).max(axis=1)
        now = t[:, -1]
        go = now < latest[home]
        item, rate, home, now = item[go], rate[go], home[go], now[go]
        step += block
        block = min(64, max(1, 2_000_000 // max(1, len(item))), block * 2)
    return owner.reshape(n, registers)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, two digests of the shingle set, its size, register bits, more register bits, band keys); texts without words are left out."""
    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        at = 0
        while at < len(ids):
            keep, sets, weights, held = [], [], [], 0
            while at < len(ids) and len(keep) < 256 and held < 200_000:
                s = shingles(texts[at])
                if len(s):
                    u = np.unique(s)
                    keep.append(ids[at]), sets.append(u), weights.append(np.ones(len(u)))
                    held += len(u)
                at += 1
            if not keep:
                continue
            sig = signatures(sets, weights, ROWS * BANDS).reshape(len(keep), BANDS, ROWS)
            flat = sig.reshape(len(keep), -1)[:, :128] & np.uint64(1)
            bits = [np.bitwise_or.reduce(flat[:, at:at + 64] << np.arange(64, dtype=np.uint64), axis=1).view(np.int64) for at in (0, 64)]
            four = (sig.reshape(len(keep), -1)[:, :NIBBLES] & np.uint64(15)).reshape(len(keep), NIBBLES // 16, 16)
            four = np.bitwise_or.reduce(four << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=2).view(np.int64)
            key = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(keep), 1))
            for j in range(ROWS):
                key = _mix(key * _GOLD + sig[:, :, j])
            size = np.array([len(u) for u in sets], np.int64)
            one = np.array([np.bitwise_xor.reduce(_mix(u)) for u in sets]) + size.astype(np.uint64)
            two = np.array([np.add.reduce(_mix(u ^ _GOLD)) for u in sets])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keep, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(size),
                 *map(pa.array, bits), pa.array(list(four), pa.list_(pa.int64())), pa.array(list(key.view(np.int64)), pa.list_(pa.int64()))],
                names=["id", "d1", "d2", "size", "low", "high", "four", "keys"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, sorted 32-bit shingle set)."""
    for b in batches:
        sets = [np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32)).tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["id", "set"])


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to one row (shingle, id, n) for each of a text's n distinct 32-bit shingles."""
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            u = np.unique((shingles(t) >> np.uint64(32)).astype(np.uint32)).view(np.int32)
            for at in range(0, len(u), 50_000):
                part = u[at:at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), i, np.int64)), pa.array(np.full(len(part), len(u), np.int32))],
                                                 names=["shingle", "id", "n"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) to the pairs that reach the similarity."""
    for x in batches:
        ok = []
        for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)]), kind="stable")
            shared = int((both[1:] == both[:-1]).sum())
            ok.append(shared >= SIMILARITY * (len(both) - shared) - 1e-9)
        keep = pa.array(ok, pa.bool_())
        yield pa.RecordBatch.from_arrays([x.column(0).filter(keep), x.column(1).filter(keep)], names=["a", "b"])


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: key, class_id, class_size, group_id, group_size, keep.

    Two texts are near duplicates if the Jaccard similarity of their sets of five-word shingles is
    0.8 or more; texts of one to four words are one shingle, and texts without words (null, empty,
    blank) are alone. A class is the documents with one set, named by its smallest key; a group is a
    connected component of classes, and keep marks its smallest key. Keys are integers that name
    documents: rows that repeat a key are one document (with several texts, that of the smallest
    class counts); rows with a null key are alone, with null ids, and kept. An empty table gives no rows.
    """
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("t"))
    sk = store(docs.mapInArrow(_sketch, "id long, d1 long, d2 long, size long, low long, high long, four array<long>, keys array<long>"), "sketch")
    classes = sk.groupBy("d1", "d2").agg(F.min("id").alias("class_id"), F.countDistinct("id").alias("class_size"))
    classed = store(sk.join(classes, ["d1", "d2"]), "classes")
    rows = classed.where("id = class_id").select(F.explode(F.array_distinct("keys")).alias("key"), "id", F.struct("size", "low", "high").alias("x")).distinct()

    def may(p: Column, q: Column) -> Column:
        differ = F.bit_count(p["low"].bitwiseXOR(q["low"])) + F.bit_count(p["high"].bitwiseXOR(q["high"]))
        least = F.least(p["size"], q["size"])
        return (least >= SIMILARITY * F.greatest(p["size"], q["size"]) - 1e-9) & ((least < BITS_FROM) | (differ <= 128 - BITS_AGREE))

    def common(left: DataFrame) -> DataFrame:
        """Of each member's set its size and the part that another component has too; members with too small a part have no link to one."""
        ids = store(left.select("id").distinct(), "ids")
        held = store(with_ids(docs, ids, "id").mapInArrow(_members, "shingle int, id long, n int").join(left, "id"), "members")
        alone = held.groupBy("shingle").agg(F.min("root").alias("root"), F.max("root").alias("most")).where("root = most").select("shingle")
        alone = held.join(alone, "shingle", "left_semi").groupBy("id").agg(F.countDistinct("shingle").alias("alone"))
        part = held.groupBy("id").agg(F.max("n").cast("long").alias("n")).join(alone, "id", "left")
        small = held.where(F.col("n") <= SET_SIZE).groupBy("id").agg(F.collect_set("shingle").alias("set"))
        part = part.join(small, "id", "left")
        bits = with_ids(classed.select("id", "size", "four"), ids, "id").distinct()
        texts = bits.groupBy("id").agg(F.count(F.lit(1)).alias("texts"))
        x = bits.join(texts, "id").join(part, "id")
        # The parts of a key with several texts are not known.
        size = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.col("size"))
        known = F.when((F.col("texts") == 1) & (F.size("set") == F.col("n")), F.col("set"))
        x = x.select("id", "four", known.alias("set"), size.alias("size"), (size - F.when(F.col("texts") == 1, F.coalesce("alone", F.lit(0))).otherwise(0)).alias("part"))
        return x.where(F.col("part") >= SIMILARITY * F.col("size") - 1e-9).select("id", F.struct("size", "four", "part", "set").alias("x"))

    def may_share(p: Column, q: Column) -> Column:
        # No pair shares more than the smaller of the two parts.
        most = F.least(p["part"], q["part"])
        ones = F.lit(0x1111111111111111).cast("long")
        differ = F.lit(0)
        for k in range(NIBBLES // 16):
            d = F.get(p["four"], F.lit(k)).bitwiseXOR(F.get(q["four"], F.lit(k)))
            d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
            differ += F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 2)).bitwiseAND(ones))
        # Named once, so that only pairs that pass the other tests compute it.
        shared = F.size(F.array_intersect(p["set"], q["set"]))
        exact = p["set"].isNull() | q["set"].isNull() | ((1 + SIMILARITY) * shared >= SIMILARITY * (p["size"] + q["size"]) - 1e-9)
        return (most >= SIMILARITY * (p["size"] + q["size"] - most) - 1e-9) & (differ <= NIBBLES - NIBBLES_AGREE) & exact

    def verify(pairs: DataFrame) -> DataFrame:
        ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
        sets = store(with_ids(docs, ids, "id").mapInArrow(_sets, "id long, set binary"), "sets")
        p = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
        p = p.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b")
        return p.select("a", "b", "set_a", "set_b").mapInArrow(_similar, "a long, b long").distinct()

    comp = bucket_components(rows, may, verify, (common, may_share))
    member = classed.groupBy("id").agg(F.min(F.struct("class_id", "class_size")).alias("c"))
    out = member.join(comp, member["c.class_id"] == comp["node"], "left").select(
        "id", "c.class_id", "c.class_size", F.coalesce("root", "c.class_id").alias("group_id"))
    out = out.join(out.groupBy("group_id").agg(F.count(F.lit(1)).alias("group_size")), "group_id")
    one, own = F.lit(1).cast("long"), F.col(key).cast("long")
    return df.select(key).join(out, own == out["id"], "left").select(
        key, F.coalesce("class_id", own).alias("class_id"), F.coalesce("class_size", one).alias("class_size"),
        F.coalesce("group_id", own).alias("group_id"), F.coalesce("group_size", one).alias("group_size"),
        F.coalesce(own == F.coalesce("group_id", own), F.lit(True)).alias("keep"))


@other_columns_aside()
def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` with one document of each group (see ``near_duplicates``), all columns; rows that repeat a kept key stay."""
    gone = near_duplicates(df, key, text).where("not keep").select(F.col(key).alias("gone_key__")).distinct()
    return df.join(gone, df[key].cast("long") == F.col("gone_key__").cast("long"), "left_anti")
