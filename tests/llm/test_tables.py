"""Mixing, sharding and decontamination: laws, brute force and the SQL oracles."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from wardlens.llm import decontam, mixing, queries, sharding

from .util import BASE, SF, frame, odd_rows, rows_of, words


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df, rel = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLE[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    assert rows_of(df, *cols) == sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)


def test_mix_meets_targets(spark):
    rng = random.Random(1)
    rows = [(k, " ".join(["w"] * rng.randrange(30)), "en", rng.choice(["a", "a", "a", "a", "é", "b", None])) for k in range(3000)]
    out = mixing.mix(frame(spark, rows).withColumn("Target", F.lit(0))).collect()
    total = Counter()
    for _, t, _, s in rows:
        total[s] += len(words(t))
    weight = dict(zip(["a", "b", "é", None], [3, 1, 2, 3], strict=True))
    low, high = 0.0, 1e9
    for _ in range(200):  # the level of the water, by bisection
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * total[s], mid * w) for s, w in weight.items()) < 1.5 * sum(total.values()) else (low, mid)
    taken = Counter()
    for r in out:
        taken[r.source] += r.taken
        assert r.taken == r.size * r.times and r.times in (0, 1, 2) and r.source_size == total[r.source]
        assert r.target == pytest.approx(min(2 * total[r.source], low * weight[r.source]), abs=1e-3)
    assert all(abs(taken[r.source] - r.target) <= 15 for r in out)


def test_mix_on_odd_tables(spark):
    out = mixing.mix(frame(spark, odd_rows()))
    assert out.count() == len(odd_rows()) and out.where("taken is null or times > 2").count() == 0
    assert rows_of(out, "doc_id", "times") == rows_of(mixing.mix(frame(spark, odd_rows()).repartition(5)), "doc_id", "times")
    assert mixing.mix(frame(spark, [])).count() == 0
    assert mixing.mix(frame(spark, [(1, None), (2, "")])).agg(F.sum("taken")).first()[0] == 0


def test_shards_follow_the_law_and_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 50)
    rows = [(k, f"t{k % 7}", "en", "hot" if k % 3 else f"s{k % 5}") for k in range(1003)]
    out = sharding.shard(frame(spark, rows).withColumn("SLOT", F.lit(0)).repartition(7), shards=16).collect()
    counts = Counter(r.shard for r in out)
    assert sorted(counts) == list(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())
    for source, n in Counter(r[3] for r in rows).items():
        each = Counter(r.shard for r in out if r.source == source)
        assert all(abs(each[s] - n / 16) <= 2 for s in range(16))
    assert all(r.text_crc32 == zlib.crc32(r.text.encode()) and r.size == len(r.text) + 1 and r.law == "rows" for r in out)
    again = sharding.shard(frame(spark, rows).repartition(3, "text"), shards=16).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in out} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_on_odd_tables(spark):
    out = sharding.shard(frame(spark, odd_rows()), shards=4).collect()
    assert len(out) == len(odd_rows()) and {r.size for r in out if not r.text} == {1} and {r.grown_shard for r in out} == {None}
    assert sorted((r.shard, r.slot) for r in out) == [(s, k) for s, n in sorted(Counter(r.shard for r in out).items()) for k in range(n)]
    assert sharding.shard(frame(spark, [])).count() == 0
    assert queries.op8_shard(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def norm_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_marks(docs, bench):
    windows = set()
    for item, t in bench:
        w = norm_words(t)
        n = min(10, len(w))
        windows |= {(str(item), tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n}
    out = []
    for doc, t, *_ in docs:
        w, hit, items = norm_words(t), set(), set()
        for item, g in windows:
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i:i + len(g)]) == g:
                    hit.update(range(i, i + len(g)))
                    items.add(item)
        out.append((doc, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


MARKS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
BENCH = [(1, BASE), (2, "short ITEM here"), (3, None), (4, "..."), (5, "É à"), (22, BASE.upper() + "!"), (33, "short item here"), (6, "a b c d e f g"), (7, "solo"),
         (8, "p q r s t u"), (9, "one two three four five six seven eight nine"), (10, "v w x y z"), (11, "k l m n"), (12, "one two three four five six seven eight")]


def docs_with_hits():
    w = BASE.split()
    return [*odd_rows(), (30, " ".join(["pad"] * 5 + w[3:14] + ["x"] + w[2:12])), (31, "a-short  item.HERE, short item here"), (32, "É À é à"),
            (33, " ".join(w[:9])), (34, "a b c d e f g h p q r s t u v w x y z k l m n"), (35, "One two three four five six seven eight nine"), (36, "\x00solo\x00")]


def test_marks_equal_brute_force(spark, monkeypatch):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = frame(spark, docs_with_hits()).withColumn("items", F.lit(1)).withColumn("n_words", F.lit(1))
    want = brute_marks(docs_with_hits(), BENCH)
    assert rows_of(decontam.mark(df, bench), *MARKS) == want
    monkeypatch.setattr(decontam, "BROADCAST_GRAMS", 0)
    assert rows_of(decontam.mark(df, bench), *MARKS) == want
    assert decontam.mark(df, bench.limit(0)).where("contaminated").count() == 0
    assert decontam.mark(df.limit(0), bench).count() == 0


def test_bit_table_grows_with_the_benchmark(spark, monkeypatch):
    sizes = [decontam.bit_words(n) for n in (0, 1, 1 << 14, (1 << 14) + 1, 100_000, 10**9)]
    assert sizes == [1 << 14, 1 << 14, 1 << 14, 1 << 15, 1 << 17, 1 << 18]
    bench, df = spark.createDataFrame(BENCH, "item_id long, text string"), frame(spark, docs_with_hits())
    want = brute_marks(docs_with_hits(), BENCH)
    # A full table lets every window pass, and a larger one moves its bits: the rows are the same.
    for words, most, broadcast in ((1, 1, 1 << 20), (1, 1 << 18, 1 << 20), (1 << 17, 1 << 18, 0)):
        monkeypatch.setattr(decontam, "BIT_WORDS", words)
        monkeypatch.setattr(decontam, "MOST_WORDS", most)
        monkeypatch.setattr(decontam, "BROADCAST_BYTES", broadcast)
        assert rows_of(decontam.mark(df, bench), *MARKS) == want


def test_contaminated_rows_or_spans_go(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    df = frame(spark, docs_with_hits()).withColumn("items", F.lit(1))
    bad = {r[0] for r in brute_marks(docs_with_hits(), BENCH) if r[-1]}
    kept = decontam.decontaminate(df, bench)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in docs_with_hits() if r[0] not in bad)
    cut = decontam.decontaminate(df, bench, remove="spans").collect()
    assert len(cut) == len(docs_with_hits()) and next(r.text for r in cut if r.doc_id == 30) == "pad pad pad pad pad x"
    assert {r.text for r in cut if r.doc_id == 5} == {odd_rows()[4][1]}
