"""Near duplicates that repeat their shingles differently, or have few, against brute force."""

import random

from wardlens.llm import minhash

from .test_dedup import brute_groups, shingle_set
from .util import frame


def jaccard(a, b):
    a, b = shingle_set(a), shingle_set(b)
    return len(a & b) / len(a | b)


def test_repeated_passages_lose_no_link(spark):
    """Half of what two texts share is repeated in one of them, the other half in the other."""
    rng, rows = random.Random(4), []
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for _ in range(150):
        p, q = some(100), some(100)
        pair = [" ".join(p * 20 + q + some(17)), " ".join(p + q * 20 + some(17))]
        assert 0.8 <= jaccard(*pair) <= 0.85
        rows += pair
    rows = list(enumerate(rows))
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.group_id for r in out} == brute_groups(rows)


def test_small_sets_lose_no_link(spark):
    """Texts of five and four shingles, four of them shared: the bits of few shingles may all differ."""
    rng, rows = random.Random(5), []
    for _ in range(8000):
        w = [f"w{rng.randrange(10**6)}" for _ in range(9)]
        rows += [" ".join(w), " ".join(w[:8])]
    rows = list(enumerate(rows))
    out = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: r.group_id for r in out} == brute_groups(rows)
