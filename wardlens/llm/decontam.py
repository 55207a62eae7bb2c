"""Benchmark decontamination by a broadcast set of normalised n-grams, with DataFrame functions only.

Benchmark items become a small table of distinct windows. Each training text is scanned once in
its own row: hashes of all its token windows are tested against a bit table made from the
benchmark windows and sized by their number, and only the passing windows are spelled out and verified by an equality join on their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import other_columns_aside

#: Words are letters (lower-cased A-Z), digits and everything beyond ASCII; the rest separates.
SEP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: 64-bit words of the window test: a power of two, one word at least for each distinct benchmark window (then one other window
#: in 64 passes), within these bounds (128 KB to 2 MB). Beyond 262,144 windows more pass by chance; the verifying join tells them apart.
BIT_WORDS, MOST_WORDS = 1 << 14, 1 << 18
#: Above this many distinct benchmark windows, or bytes of them and their item ids, the verifying join is left to Spark instead of broadcast.
BROADCAST_GRAMS, BROADCAST_BYTES = 200_000, 32 << 20


def tokens(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the array of normalised words; empty for null and for texts without a word."""
    t = F.coalesce(F.col(text), F.lit(""))
    # lower() also folds letters beyond ASCII, so it serves only where there are none.
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))
    d = df.withColumn(out, F.split(low, SEP))
    s = F.col(out)
    first = F.when(F.get(s, F.lit(0)) == "", 2).otherwise(1)
    last = F.when((F.size(s) > 1) & (F.get(s, F.size(s) - 1) == ""), F.size(s) - 1).otherwise(F.size(s))
    return d.withColumn(out, F.slice(s, first, F.greatest(last - first + 1, F.lit(0))))


def _join(a: Column, b: Column, step: int) -> Column:
    """Hashes of windows made of the window in ``a`` and the one ``step`` words later in ``b``."""
    return F.zip_with(a, F.slice(b, step + 1, F.size(b)), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y)))


def window_hashes(df: DataFrame, w: str, lengths: list[int]) -> DataFrame:
    """Adds ``h_L`` for each wanted length: hash of the L words from each position (null past the end).

    Built by doubling, one select per step so that each array is computed once per row.
    """
    d = df.withColumn("h_1", F.transform(w, lambda x: F.xxhash64(x)))
    have = {1}
    for n in (2, 4, 8):
        if n <= max(lengths):
            d = d.withColumn(f"h_{n}", _join(F.col(f"h_{n // 2}"), F.col(f"h_{n // 2}"), n // 2))
            have.add(n)
    for n in sorted(set(lengths) - have):
        top = max(p for p in (1, 2, 4, 8) if p < n)
        rest = n - top
        if rest not in have:  # 7 = 4 + 3
            d = d.withColumn(f"h_{rest}", _join(F.col("h_2"), F.col("h_1"), 2))
            have.add(rest)
        d = d.withColumn(f"h_{n}", _join(F.col(f"h_{top}"), F.col(f"h_{rest}"), top))
        have.add(n)
    return d.drop(*[f"h_{n}" for n in have if n not in lengths])


def benchmark_windows(bench: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct windows (len, gram) of the items, with the ids of the items that hold them."""
    b = tokens(bench.select(F.col(item).cast("string").alias("item"), F.col(text).alias("t_")), "t_", "w_").where(F.size("w_") > 0)
    n = F.least(F.size("w_"), F.lit(window))
    b = b.select("item", n.alias("len"), F.explode(F.transform(
        F.sequence(F.lit(1), F.size("w_") - n + 1), lambda i: F.array_join(F.slice("w_", i, n), " "))).alias("gram"))
    return b.groupBy("len", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))


def bit_words(windows: int) -> int:
    """Words of the test for so many windows."""
    return min(MOST_WORDS, max(BIT_WORDS, 1 << max(0, windows - 1).bit_length()))


def _bit_table(grams: DataFrame, lengths: list[int], size: int) -> Column:
    """The test's bits as a constant array; at most ``size`` numbers come to the driver."""
    g = window_hashes(grams.select("len", F.split("gram", " ").alias("w_")), "w_", lengths)
    h = F.coalesce(*[F.when(F.col("len") == n, F.get(f"h_{n}", F.lit(0))) for n in lengths])
    bits = g.select(h.alias("h")).groupBy(_word_of(F.col("h"), size).alias("k")).agg(F.bit_or(_bit_of(F.col("h"))).alias("v")).collect()
    table = [0] * size
    for r in bits:
        table[r.k] = r.v
    return F.from_json(F.lit(str(table)), "array<bigint>")


def _word_of(h: Column, size: int) -> Column:
    return F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(size - 1)).cast("int")


def _bit_of(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))


def mark(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
         bench_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of ``df``: key, text_md5, n_words, n_hit, hit_spans, items, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item; an item of fewer (but some) words is one
    window. hit_spans are the maximal runs (first word, word after) covered by occurrences. Null,
    empty and wordless texts have 0 words and are clean; items without words match nothing; an
    empty benchmark leaves all clean. Repeated rows each get their row; other columns are not read.
    """
    grams = benchmark_windows(bench, item, bench_text, window).persist()
    n_bytes = F.octet_length("gram") + F.octet_length(F.array_join("items", ",")) + 16 * F.size("items")
    by_len = grams.groupBy("len").agg(F.count("*").alias("n"), F.sum(n_bytes.cast("long")).alias("bytes")).collect()  # at most ``window`` rows
    lengths = sorted(r["len"] for r in by_len) or [window]
    n = sum(r["n"] for r in by_len)
    size, fits = bit_words(n), n <= BROADCAST_GRAMS and sum(r["bytes"] for r in by_len) <= BROADCAST_BYTES
    table = _bit_table(grams, lengths, size)
    d = tokens(df.select(F.col(key).alias("key_"), F.md5(F.col(text)).alias("fp_"), F.col(text).alias("t_")), "t_", "w_").drop("t_")
    d = window_hashes(d.withColumn("n_words", F.size("w_").cast("long")), "w_", lengths)

    def passing(n: int) -> Column:
        ok = lambda h: F.get(table, _word_of(h, size)).bitwiseAND(_bit_of(h)) != 0
        at = F.array_compact(F.transform(F.col(f"h_{n}"), lambda h, i: F.when(h.isNotNull() & ok(h), i)))
        return F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(n).alias("len"), F.array_join(F.slice("w_", i + 1, n), " ").alias("gram")))

    d = d.select("key_", "fp_", "n_words", F.concat(*[passing(n) for n in lengths]).alias("c_"))
    d = d.select("key_", "fp_", "n_words", F.posexplode_outer("c_").alias("nth_", "c_")).select(
        "key_", "fp_", "n_words", "nth_", F.col("c_.i").alias("i"), F.col("c_.len").alias("len"), F.col("c_.gram").alias("gram"))
    d = d.join(F.broadcast(grams) if fits else grams, ["len", "gram"], "left")
    hit = F.col("items").isNotNull()
    d = d.groupBy("key_", "fp_", "n_words").agg(
        F.count(F.when(F.coalesce("nth_", F.lit(0)) == 0, 1)).alias("copies_"),
        F.array_sort(F.collect_set(F.when(hit, F.struct(F.col("i").alias("s"), (F.col("i") + F.col("len")).alias("e"))))).alias("at_"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    none = F.array().cast("array<struct<s:int,e:int>>")
    d = d.withColumn("hit_spans", F.aggregate("at_", none, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["e"] >= x["s"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.element_at(acc, -1)["s"].alias("s"), F.greatest(F.element_at(acc, -1)["e"], x["e"]).alias("e")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e")))))))
    d = d.withColumn("n_hit", F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("copies_").cast("int"))).alias("copy_"))
    return d.select(F.col("key_").alias(key), F.col("fp_").alias("text_md5"), "n_words", "n_hit", "hit_spans", "items",
                    F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                    (F.col("n_hit") > 0).alias("contaminated"))


@other_columns_aside()
def decontaminate(df: DataFrame, bench: DataFrame, key: str = "doc_id", text: str = "text", remove: str = "documents", **names) -> DataFrame:
    """``df`` without contaminated rows, or (``remove='spans'``) with the hit words taken out of the texts.

    Untouched texts stay as they are; a cut text is its remaining normalised words joined by
    spaces. Same handling of nulls, empty and repeated rows as ``mark``; all columns are kept.
    """
    bad = mark(df, bench, key, text, **names).where("contaminated").select(
        F.col(key).alias("key__"), F.col("text_md5").alias("fp__"), F.col("hit_spans").alias("spans__")).distinct()
    on = df[key].eqNullSafe(F.col("key__")) & (F.md5(df[text]) == F.col("fp__"))
    if remove == "documents":
        return df.join(bad, on, "left_anti")
    d = tokens(df.join(bad, on, "left"), text, "w__")
    kept = F.filter("w__", lambda w, i: ~F.exists("spans__", lambda s: (s["s"] <= i) & (i < s["e"])))
    return d.withColumn(text, F.when(F.col("spans__").isNull(), F.col(text)).otherwise(F.array_join(kept, " "))).select(*df.columns)


#: The same rows in DuckDB, by plain window joins.
MARK_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
       FROM (SELECT item, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM bw WHERE len(w) > 0)),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
hits AS (SELECT dg.doc_id, dg.i, dg.n, bg.item FROM dg JOIN bg ON dg.n = bg.n AND dg.gram = bg.gram),
hw AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM hits) GROUP BY 1),
it AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY 1)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)
"""
