"""Conversation repair against exhaustive search over whole edit lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wardlens.llm import conversation_repair as cr
from wardlens.llm import queries

from .util import SF

SCHEMA = "conv_id long, turn long, role string, text string"
COLS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(rows):
    """conversation -> rows (turn, role, text) after damage, in order."""
    out = defaultdict(list)
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        r = "user" if h == 4 else r
        out[c] += [(t, r, x)] * {0: 0, 3: 2}.get(h, 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, r, x in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", x)
        out.append("blank" if not said else "duplicate" if (r, x) in seen else "truncated" if said[-1] not in ".!?" else "")
        seen.add((r, x))
    return out


def cheapest(rows, fault):
    """Least (cost, audit, turns) by trying every edit list, states being plain strings of initials; two inserts at most stand together."""
    best = {"": (0, "", ())}

    def put(table, seq, path):
        if re.fullmatch("(s?(ua)*u?)?", seq) and (seq not in table or path[:2] < table[seq][:2]):
            table[seq] = path

    def inserted(table):
        for _ in range(2):
            for seq, (c, a, t) in list(table.items()):
                for role in ("user", "assistant"):
                    put(table, seq + role[0], (c + 3, a + "I", (*t, (role, ""))))
        # Longer strings that end alike go on alike, so one for each ending is enough.
        short = {}
        for seq, path in table.items():
            end = seq if len(seq) < 2 else "s" * seq.startswith("s") * (len(seq) == 1) + ("ua" if seq[-1] == "a" else "uau" if len(seq) > 2 or seq[0] == "u" else seq)
            if end not in short or path[:2] < short[end][:2]:
                short[end] = path
        return short

    for (_, r, x), f in zip(rows, fault, strict=True):
        new = {}
        for seq, (c, a, t) in inserted(best).items():
            put(new, seq, (c + 4, a + "D", t))
            if f not in ("blank", "duplicate"):
                extra = 3 * (f == "truncated")
                put(new, seq + r[:1], (c + extra, a + "K", (*t, (r, x)))) if r[:1] else None
                for role in ("user", "assistant"):
                    put(new, seq + role[0], (c + 3 + extra, a + "R", (*t, (role, x))))
        best = new
    ends = [p for seq, p in inserted(best).items() if re.fullmatch("(s?(ua)+)?", seq)]
    return min(ends, key=lambda p: p[:2])


def brute(rows):
    out = []
    by = damaged(rows)
    for c in by.keys() | {r[0] for r in rows}:
        own = by.get(c, [])
        f, turns = faults(own), {t for t, *_ in own if t is not None}
        cost, audit, kept = cheapest(own, f)
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:], strict=False)]
        sha = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, f.count("blank"), f.count("duplicate"), f.count("truncated"),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha))
    return sorted(out, key=repr)


def random_rows(n_conv=120, longest=9, seed=5):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    texts = ["Hi.", "Yes!", "no end", " \t", "", None, "Why?  \n", "é ü.", "so "]
    return [(c, rng.choice([None, t, t, t, t + 3, 1]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.")
            for c in [None, *range(n_conv)] for t in range(rng.randrange(1, longest))]


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("present", F.lit(0)).withColumn("fault", F.lit(9)).repartition(5)
    d = cr.damage(df)
    return sorted((tuple(r[c] for c in COLS) for r in cr.repair(d, present=F.col("present"), **kw).collect()), key=repr)


@pytest.mark.parametrize("block", [2, 3, 32])
def test_repair_equals_exhaustive_search(spark, monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK_ROWS", block)
    rows = random_rows()
    want = brute(rows)
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c] += [(t, r, x)]
    out = []
    for c, own in damaged(rows).items():  # the search itself, with small blocks that workers of a session would not see
        now, seen = cr.Conversation(c), set()
        for (t, r, x), f in zip(own, faults(own), strict=True):
            now.add(t, r, x, {"blank": cr.BLANK, "duplicate": cr.DUPLICATE, "truncated": cr.CUT, "": cr.SOUND}[f])
        now.solve(True)
        out.append(tuple(now.report()[k] for k in COLS))
    out += [w for w in want if w[0] not in {o[0] for o in out}]
    assert sorted(out, key=repr) == want
    if block == 32:
        assert got(spark, rows) == want


def test_query_equals_exhaustive_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in COLS) for r in queries.op12_conversation_repair(spark, SF).collect()), key=repr) == brute(rows)


def test_long_conversation_and_copies(spark):
    rng = random.Random(2)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["same.", f"t{t}.", f"cut {t}"])) for t in range(600)]
    rows += [(2, 0, "user", "again.")] * 500
    assert got(spark, rows) == brute(rows)


def test_repaired_turns_make_the_hash(spark):
    d = cr.damage(spark.createDataFrame(random_rows(30), SCHEMA))
    report = {r.conv_id: r for r in cr.repair(d, present=F.col("present")).collect()}
    turns = defaultdict(list)
    for r in cr.repair(d, present=F.col("present"), turns=True).orderBy("place").collect():
        turns[r.conv_id].append(r)
    for c, r in report.items():
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in turns[c]).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in turns[c])) and "".join(x.edit for x in turns[c]) == r.audit.replace("D", "")


def test_empty_and_dropped(spark):
    assert got(spark, []) == []
    turn = next(t for t in range(200) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    assert got(spark, [(4, turn, "user", "x.")]) == [(4, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
