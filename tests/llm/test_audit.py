"""Filter audit against plain simulation, and its SQL on odd tables."""

import random
from itertools import permutations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from wardlens.llm import filter_audit

from .util import frame, odd_rows, words

COLS = ("part", "filter_order", "step", *filter_audit.MEASURES)


def brute(rows, labels):
    """rows: (doc_id, text, lang, source); labels: (doc_id, quality, toxic)."""
    owner = {}
    for k, t, *_ in rows:
        if k is not None:
            owner[t or ""] = min(k, owner.get(t or "", k))
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, x in labels if x == 1 and k is not None}
    docs = []
    for k, t, _, s in rows:
        t, w = t or "", words(t)
        fails = "A" * (len(w) < 200) + "B" * (100 * len(set(w)) < 50 * len(w)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t))
        fails += "D" * any(c in "#$%&*|" for c in t) + "E" * (k is not None and k > owner[t])
        docs.append((s or "", set(fails), k in good, k in toxic))
    out = []
    for part in {d[0] for d in docs}:
        own, removed_in = [d for d in docs if d[0] == part], dict.fromkeys("ABCDE", 0)
        table = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_in[x] += len(gone)
                table.append([part, "".join(order), step, len(left), len(gone), sum(x in d[1] for d in own) - len(gone), sum(d[1] == {x} for d in own),
                              sum(d[2] for d in gone), sum(d[3] for d in gone)])
        out += [(*r, removed_in[r[1][r[2] - 1]]) for r in table]
    return sorted(out)


def audited(spark, rows, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, rows).withColumn("mask", F.lit(9)).withColumn("id", F.lit("x")).withColumn("digest", F.lit(1)).withColumn("n", F.lit(2)).withColumn("good", F.lit(1))
    return sorted(tuple(r[c] for c in COLS) for r in filter_audit.audit(df, lab.withColumn("good", F.lit(5))).collect())


def random_rows(n=400):
    rng = random.Random(4)
    texts = [None, "", "Ab c", " ".join(f"w{i}" for i in range(250)), "x y " * 150, "X" * 30 + " a b $", "# " + " ".join(f"v{i}" for i in range(201))]
    return [(rng.choice([None, *range(n // 2)]), rng.choice(texts), "en", rng.choice(["a", "a", "b", None, ""])) for _ in range(n)]


LABELS = [(k, k % 2, k % 3 % 2) for k in range(150)] + [(7, 0, 1), (8, None, None), (None, 1, 1), (7, 1, 0)]


def test_audit_equals_simulation(spark):
    rows = random_rows()
    assert audited(spark, rows, LABELS) == brute(rows, LABELS)


def test_audit_on_odd_tables(spark):
    rows = [(*r, *["en", "a"][len(r) - 2:]) for r in odd_rows()]
    got = audited(spark, rows, LABELS)
    assert got == brute(rows, LABELS) and len(got) == 600 * len({r[3] or "" for r in rows})
    assert audited(spark, [], []) == []


def test_sql_agrees_on_random_rows(spark):
    rows = random_rows()
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas().astype({"doc_id": "Int64"}))
    con.register("labels", spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").toPandas().astype("Int64"))
    rel = con.sql(filter_audit.AUDIT_SQL)
    assert sorted(tuple(r[rel.columns.index(c)] for c in COLS) for r in rel.fetchall()) == brute(rows, LABELS)


def test_intervals_cover_each_order_once():
    removed, again = filter_audit.rank_intervals(4)
    for mask in range(1, 16):
        seen = np.zeros(24, int)
        for _, _, a, b in removed[removed[:, 0] == mask]:
            seen[a:b] += 1
        assert (seen == 1).all()
        for _, _, a, b in again[again[:, 0] == mask]:
            seen[a:b] += 1
        assert (seen == bin(mask).count("1")).all()
