"""Substring, document and line deduplication against brute force."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from wardlens.llm import common, line_dedup, minhash, queries, suffix_dedup

from .util import BASE, SF, frame, odd_rows, rows_of, words


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def link(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def brute_substrings(rows, n=50):
    first = {}
    raws = [(k, (t or "").encode()) for k, t, *_ in rows]
    for k, b in raws:
        if k is not None:
            for i in range(len(b) - n + 1):
                first[b[i:i + n]] = min(k, first.get(b[i:i + n], k))
    out = []
    for k, b in raws:
        gone = bytearray(len(b))
        for i in range(len(b) - n + 1):
            if k is not None and first[b[i:i + n]] < k:
                gone[i:i + n] = b"\1" * n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((k, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=repr)


CUT = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def substrings(df):
    return rows_of(suffix_dedup.dedup_substrings(df).withColumn("n_spans", F.size("spans")), *CUT)


def test_substrings_equal_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op1_suffix_dedup(spark, SF), *CUT) == brute_substrings(rows)


def mosaic(rng, n):
    """Texts cut from shared passages at random places, so that windows overlap, touch and just miss 50 bytes."""
    alphabet = "abcdé "
    pool = ["".join(rng.choice(alphabet) for _ in range(rng.choice([30, 60, 90, 150, 400]))) for _ in range(25)] + ["ab" * 60, "a" * 130, BASE]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            p = rng.choice(pool)
            i = rng.randrange(len(p))
            parts.append(p[i:i + rng.choice([20, 48, 49, 50, 51, 80, 400])])
            if rng.random() < 0.5:
                parts.append("".join(rng.choice(alphabet) for _ in range(rng.randrange(40))))
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("seed", range(3))
def test_substrings_equal_brute_force_on_mosaics(spark, monkeypatch, seed):
    rng = random.Random(seed)
    texts = mosaic(rng, 150)
    ids = rng.sample(range(-100, 1000), len(texts))
    rows = list(zip(ids, texts, strict=True)) + odd_rows() * (seed == 0)
    if seed:  # many flushes and pieces: what one task settles is then a part only
        monkeypatch.setattr(suffix_dedup, "HELD", 200)
        monkeypatch.setattr(suffix_dedup, "CHUNK", 64)
    df = frame(spark, rows).withColumn("KEPT", F.lit(1)).withColumn("a", F.lit(1)).withColumn("key__", F.lit(2)).repartition(4)
    assert substrings(df) == brute_substrings(rows)


def test_substrings_on_odd_tables(spark):
    out = suffix_dedup.dedup_substrings(frame(spark, [(7, "x" * 300_000 + BASE), (9, BASE), (8, "x" * 49), (3, "x" * 50)])).collect()
    got = {r.doc_id: r for r in out}
    assert [got[k].n_removed for k in (3, 7, 8, 9)] == [0, 300_000, 0, len(BASE)] and got[7].kept == BASE.encode()
    assert out[0].asDict().keys() >= {"lang", "source", "kept", "spans"} and "text" not in out[0].asDict()
    assert substrings(frame(spark, [])) == []
    assert substrings(frame(spark, [(1, None), (2, "")]))[0][1:4] == (0, 0, 0)


def test_stretches_depend_on_content_only():
    rng = np.random.default_rng(0)
    core = rng.integers(97, 100, 400, dtype=np.uint8)
    found = []
    for pad in (0, 3, 77):
        raw = np.concatenate([rng.integers(97, 123, pad, dtype=np.uint8), core])
        p, at, n, h, g = suffix_dedup.stretches(raw, np.array([pad]), np.array([len(raw)]))
        assert n.sum() == 400 - 49 and (p == 0).all()
        found.append(set(zip((at - pad).tolist(), n.tolist(), h.tolist(), g.tolist(), strict=True)))
    assert found[0] == found[1] == found[2]


def shingle_set(t):
    w = words(t)
    n = min(5, len(w))
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if n else None


def brute_groups(rows):
    sets = {k: s for k, t, *_ in rows if (s := shingle_set(t))}
    by, g = defaultdict(list), Groups()
    for k in sorted(sets):
        for x in sets[k]:
            by[x].append(k)
    for k, s in sets.items():
        for other, shared in Counter(o for x in s for o in by[x]).items():
            if shared >= 0.8 * (len(s) + len(sets[other]) - shared) - 1e-9:
                g.link(k, other)
    return {k: g.find(k) for k, *_ in rows}


def test_near_duplicates_equal_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    out = queries.op2_minhash_dedup(spark, sf).collect()
    want = brute_groups(rows)
    assert {r.doc_id: r.group_id for r in out} == want and len(out) == len(rows)
    assert all(r.keep == (r.group_id == r.doc_id) and r.group_size == Counter(want.values())[r.group_id] for r in out)


def edited(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_large_buckets_lose_no_group(spark):
    """A common passage in otherwise different texts, many variants of one text, chains of edits."""
    rng, rows = random.Random(6), []
    word = lambda: f"w{rng.randrange(10**5)}"
    passage = [word() for _ in range(60)]
    for _ in range(60):
        rows.append(" ".join(passage + [word() for _ in range(25)]))
    rows += [edited(rng, rows[k].split(), 1) for k in range(0, 60, 3)]
    base = [word() for _ in range(300)]
    rows += [edited(rng, base, rng.randrange(12)) for _ in range(60)]
    chain = [word() for _ in range(120)]
    for _ in range(25):
        rows.append(" ".join(chain))
        chain = edited(rng, chain, 2).split()
    rows = list(enumerate(rows))
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.group_id for r in out} == brute_groups(rows)


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    a, b, wa, wb = items[:240], items[60:], rng.uniform(0.2, 3, 240), rng.uniform(0.2, 3, 240)
    sig = minhash.signatures([a, b], [wa, wb], 4000)
    u, v = dict(zip(a.tolist(), wa, strict=True)), dict(zip(b.tolist(), wb, strict=True))
    want = sum(1 / sum(max(u.get(e, 0) / u[d], v.get(e, 0) / v[d]) for e in {**u, **v}) for d in u.keys() & v.keys())
    assert abs((sig[0] == sig[1]).mean() - want) < 0.03
    assert (minhash.signatures([b, a], [wb, wa], 50)[::-1] == minhash.signatures([a, b], [wa, wb], 50)).all()


def test_near_duplicates_on_odd_tables(spark):
    df = frame(spark, [*odd_rows(), (20, "one"), (21, "one\x85two three")]).withColumn("keep", F.lit("x")).withColumn("id", F.lit(3)).withColumn("t", F.lit(3))
    got = Counter((r.doc_id, r.group_id, r.group_size, r.keep) for r in minhash.near_duplicates(df).collect())
    assert got[(1, 1, 1, True)] == got[(2, 2, 1, True)] == got[(3, 3, 1, True)] == 1
    assert got[(6, 6, 2, True)] == 2 and got[(8, 6, 2, False)] == 1 and got[(None, None, 1, True)] == 1 and got[(20, 4, 2, False)] == 1
    kept = minhash.drop_near_duplicates(df)
    assert kept.columns == df.columns and Counter(r.doc_id for r in kept.collect()) == Counter({1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 2, None: 1, 9: 1, 10: 1, 21: 1})
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


def norm(line):
    return regex.sub(r"[^\p{L}\p{N}]+", " ", line.lower()).strip(" ")


def distance(a, b, most):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
        if min(row) > most:
            return most + 1
    return row[-1]


def brute_lines(rows):
    first, g = {}, Groups()
    for k, t, *_ in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]):
        for i, line in enumerate(t.split("\n")):
            if n := norm(line):
                first.setdefault(n, (k, i))
    grams = {n: Counter(n[i:i + 4] for i in range(len(n) - 3)) for n in first if len(n) >= 10}
    for a, b in combinations(grams, 2):
        most = int(0.1 * max(len(a), len(b)) + 1e-9)
        # An edit takes four of the longer line's four-character substrings at most.
        if abs(len(a) - len(b)) <= most and (grams[a] & grams[b]).total() >= max(len(a), len(b)) - 3 - 4 * most and distance(a, b, most) <= most:
            g.link(a, b)
    lead = defaultdict(list)
    for n in first:
        lead[g.find(n)].append(first[n])
    out = []
    for k, t, *_ in rows:
        lines = t.split("\n") if t is not None else []
        kept = [x for i, x in enumerate(lines) if k is None or not norm(x) or min(lead[g.find(norm(x))]) == (k, i)]
        out.append((k, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


LINES = ("doc_id", "n_lines", "n_removed", "kept_sha256")


def test_lines_equal_brute_force_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(queries.op6_line_dedup(spark, SF), *LINES) == brute_lines(rows)


def test_lines_equal_brute_force_on_variants(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9))) for _ in range(40)]
    rows = []
    for k in range(60):
        lines = [edited(rng, base, rng.randrange(3)), " ".join(base[:5]).upper() + "!", "...", "ok", f"item {k % 4}", " ".join(rng.sample(base, 12))]
        rng.shuffle(lines)
        rows.append((k, "\n".join(lines)))
    rows += [(100 + r[0] if r[0] else None, *r[1:]) for r in odd_rows()] + [(70, "ok " * 70 + "\n" + "ok " * 71)]
    df = frame(spark, rows).withColumn("N_LINES", F.lit("x")).withColumn("lines", F.lit(1)).withColumn("doc", F.lit(1))
    out = line_dedup.dedup_lines(df)
    assert rows_of(out.withColumn("kept_sha256", F.sha2(F.coalesce("text", F.lit("")), 256)), *LINES) == brute_lines(rows)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lines", "doc", "n_lines", "n_removed"]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1200)] + [(5000, k) for k in range(5001, 5100)]
    g = Groups()
    for a, b in pairs:
        g.link(a, b)
    got = common.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.root for r in got} == {x: g.find(x) for a, b in pairs if a != b for x in (a, b)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
