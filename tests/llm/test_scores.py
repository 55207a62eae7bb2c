"""Token counts, quality scores and rules, language: against libraries, brute force and held-out labels."""

import random
import zlib
from collections import Counter as Bag

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from wardlens.llm import lang_id, quality_classifier, quality_rules, queries, token_counts

from .util import BASE, SF, frame, odd_rows, rows_of, words

VOCAB = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts_equal_the_library(spark):
    lib = tokenizers.Tokenizer.from_file(VOCAB)
    got = {r.doc_id: r for r in queries.op3_token_counts(spark, SF).collect()}
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for r in texts:
        n = len(lib.encode(r.text or "", add_special_tokens=False).ids)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].n_bytes, got[r.doc_id].over_limit) == (n, len((r.text or "").encode()), n > 2048)


def test_token_counts_on_odd_texts():
    lib, rng = tokenizers.Tokenizer.from_file(VOCAB), random.Random(4)
    chars = list("aaabcdefAZ  '  \x1c\x85\n\t.,!?<|>0123éÉàÀßİΣσςñ日本語한é́🙂ﬁǅ")
    texts = ["".join(rng.choice(chars) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["a" * 3000, "ab" * 501, "don't we'll I'VE", "x<|endoftext|>y <|startoftext|><|endoftext|", "", None]
    got = token_counts.Counter(VOCAB)(texts)
    want = [len(lib.encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [(t, g, w) for t, g, w in zip(texts, got, want, strict=True) if g != w] == []


def test_token_counts_on_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 5)
    df = frame(spark, odd_rows()).withColumn("N_Tokens", F.lit("clash")).withColumn("_text", F.lit(1))
    out = token_counts.count_tokens(df, VOCAB, limit=10)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "_text", "n_bytes", "n_tokens", "over_limit"]
    assert out.count() == len(odd_rows()) and out.where("text is null or text = ''").agg(F.sum("n_tokens")).first()[0] == 0
    assert token_counts.count_tokens(df.limit(0), VOCAB).count() == 0


def repeat_words(w):
    seen = Bag(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    hit = set()
    for i in range(len(w) - 7):
        if seen[tuple(w[i:i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def stats(t):
    w, lines = words(t), [s for s in (t or "").split("\n") if words(s)]
    n, rep = len(w), repeat_words(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), rep, n < 20 or 100 * rep > 30 * n)


STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_rule_statistics_equal_brute_force(spark):
    rng = random.Random(2)
    made = [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(60))) + "\n" * rng.randrange(3)) for k in range(60)]
    rows = odd_rows() + made + [(r.doc_id + 1000, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    df = frame(spark, rows).withColumn("kept", F.lit(3)).withColumn("n_Words", F.lit(3))
    out = quality_rules.apply_rules(df, [quality_rules.Rule((("symbol_share", ">", 0.1),))])
    assert rows_of(out, "doc_id", *STATS) == sorted(((r[0], *stats(r[1])) for r in rows), key=repr)
    for r in out.collect():
        share = sum(c in "#*$%&|<>" for c in r.text or "") / max(1, len(r.text or ""))
        assert r.kept == (not r.base_failed and not share > 0.1)
    assert quality_rules.apply_rules(df.limit(0), []).count() == 0


def test_learned_rules_are_precise(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rules = quality_rules.learn_rules(quality_rules.training_rows(docs, labels))
    assert rules and all(r.conditions for r in rules)
    out = quality_rules.apply_rules(docs, rules).join(labels, "doc_id").collect()
    good = [r.kept for r in out if r.quality == 1 and not r.base_failed]
    assert sum(good) >= 0.99 * len(good)
    bad = [r.kept for r in out if r.quality == 0]
    assert sum(bad) <= 0.15 * len(bad)
    assert quality_rules.learn_rules([]) == [] and quality_rules.learn_rules(quality_rules.training_rows(docs, labels.limit(0))) == []


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op4_quality_classifier(spark, "/root/testdata/sf0.01").collect()


def auc(pairs):
    up, down = [s for s, q in pairs if q], [s for s, q in pairs if not q]
    return sum((a > b) + 0.5 * (a == b) for a in up for b in down) / (len(up) * len(down))


def test_quality_scores_on_held_out_rows(spark, scored):
    quality = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored)
    held = [(r.score, quality[r.doc_id]) for r in scored if r.held_out and r.doc_id in quality]
    assert auc(held) >= 0.95
    assert sum((s >= 0.5) == q for s, q in held) / len(held) >= 0.9


def test_quality_scores_on_odd_tables(spark):
    df = frame(spark, odd_rows()).withColumn("Score", F.lit("x"))
    labels = spark.createDataFrame([(6, 1), (10, 0), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    out = quality_classifier.score(df, quality_classifier.train(df, labels))
    assert out.count() == len(odd_rows()) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_classifier.score(df, quality_classifier.train(df, labels.limit(0))).count() == len(odd_rows())
    assert quality_classifier.score(df.limit(0), quality_classifier.train(df, labels.where("quality = 1"))).count() == 0


def test_languages_on_held_out_rows(spark):
    out = queries.op9_language_id(spark, "/root/testdata/sf0.1").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in out)
    held = [r.lang_pred == lang[r.doc_id] for r in out if r.held_out and lang[r.doc_id]]
    assert sum(held) / len(held) >= 0.95


def test_languages_on_odd_tables(spark):
    df = frame(spark, [*odd_rows(), (20, "123 ... !!"), (21, "日" * 700)]).withColumn("LANG_PRED", F.lit(1))
    model = lang_id.train(df)
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.identify(df, model).collect()}
    assert all(got[k] == ("und", 0.0) for k in (1, 2, 3, 20)) and got[21][0] in ("en", "fr") and got[5][0] == "en"
    assert lang_id.identify(df, lang_id.train(df.limit(0))).where("lang_pred <> 'und'").count() == 0
    assert lang_id.identify(df.limit(0), model).count() == 0


def test_window_logits_cover_the_whole_text():
    rows, size = lang_id.cut(BASE.encode() * 5)
    assert size.sum() == len(BASE) * 5 and (rows[0][lang_id.WINDOW:] == rows[1][:lang_id.REACH - 1]).all()
