"""Licence scan against plain search for phrases and planted notices."""

import random

from pyspark.sql import functions as F

from wardlens.llm import license_scan as ls
from wardlens.llm import queries

from .util import SF, frame, odd_rows
from .test_tables import norm_words

PHRASES = {("cc", "by"): "cc-by", ("general", "public", "license"): "gpl", ("all", "rights", "reserved"): "reserved"}
BASE = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def brute_base(rows):
    out = []
    for k, t, *_ in rows:
        w = norm_words(t)
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if tuple(w[i:i + len(p)]) == p]
        out.append((k, len(w), len(at), min(at, default=(None,))[0], max(at, default=(None,))[0], ",".join(sorted({x for _, x in at}))))
    return sorted(out, key=repr)


def scanned(spark, rows):
    df = frame(spark, rows).withColumn("score", F.lit("x")).withColumn("_text", F.lit(1)).withColumn("Found", F.lit(1))
    out = ls.scan(df, ls.build_index(df))
    assert [c for c in out.columns if c in df.columns and c != "score"] == [c for c in df.columns if c not in ("score", "Found")]
    return out.collect()


def planted(seed=3):
    rng = random.Random(seed)
    pad = lambda n: " ".join(rng.choice(["the", "of", "this", "software", "license", "public", "by", "all", "free", "x", "naïve"]) for _ in range(n))
    rows = [(i, f"{pad(rng.randrange(80))}\n{text}\n{pad(rng.randrange(80))}") for i, (_, text, _) in enumerate(ls.NOTICES)]
    return rows, [label for label, _, _ in ls.NOTICES], pad


def test_base_equals_plain_search(spark):
    rows = odd_rows() + [(20, "CC BY cc-by CC;BY by cc"), (21, "All rights reserved. all RIGHTS reserved all rights"), (22, "gnu General PUBLIC license" * 3),
                         (23, "general public license all rights reserved"), (24, "cc\x00by"), (25, "ccé by cc éby"), (26, "cc by " * 5000)]
    rows += [(100 + k, t) for k, t in planted()[0]]
    got = scanned(spark, rows)
    assert sorted((tuple(r[c] for c in BASE) for r in got), key=repr) == brute_base(rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in got)
    assert all(r.score == 0 and r.labels == "" for r in got if r.doc_id in (1, 2, 3, 4, None, 6))


def test_query_base_equals_plain_search(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((tuple(r[c] for c in BASE) for r in queries.op13_license_scan(spark, SF).collect()), key=repr) == brute_base(rows)


def test_planted_notices_are_found(spark):
    rows, labels, pad = planted()
    got = {r.doc_id: r for r in scanned(spark, rows)}
    for (k, text), label in zip(rows, labels, strict=True):
        assert label in got[k].labels.split(","), (label, got[k].labels)
        hit = next(f for f in got[k].found if f.label == label)
        assert abs(hit.first - len(norm_words(text.split("\n")[0]))) <= 1 + hit.words * ls.DRIFT and got[k].score > 0.5


def test_small_changes_are_found_and_scrambles_are_not(spark):
    mit = next(t for label, t, _ in ls.NOTICES if label == "mit" and len(t) > 100)
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i not in (30, 55))
    rng = random.Random(1)
    shuffled = " ".join(rng.sample(words, len(words)))
    no_key = mit.replace("hereby granted", "granted hereby")
    rows = [(1, "pad " * 300 + changed), (2, shuffled), (3, no_key), (4, mit + "\n" + mit)]
    got = {r.doc_id: r for r in scanned(spark, rows)}
    assert got[1].labels == "mit" and got[2].labels == got[3].labels == "" and [f.label for f in got[4].found] == ["mit", "mit"]


def test_counts_cover_the_table(spark):
    rows = [(1, "License license"), (2, None), (3, "mit"), (3, "mit"), (4, "")]
    n, held = ls.document_counts(frame(spark, rows).repartition(4), ls.templates())
    assert n == 5 and held[b"license"] == 1 and held[b"mit"] == 2 and held[b"reserved"] == 0
    empty = frame(spark, [])
    assert ls.scan(empty, ls.build_index(empty)).collect() == []
