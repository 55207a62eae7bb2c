"""Quality rules learned as an ordered decision list, emitted as Spark conditional expressions.

Statistics of a text are native column expressions. Sequential covering on a bounded sample of
labelled statistics grows one conjunction of thresholds after another (FOIL gain on two thirds of the sample),
prunes it on the rest, and keeps it while it rejects precisely enough there.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import bounded_sample, other_columns_aside, words

#: Labelled rows used for learning, at most (those with the smallest hash of the key).
SAMPLE_ROWS = 20_000
#: Words per repeated window.
SPAN = 8
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "distinct_share", "upper_share", "digit_share", "mark_share")


def statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the shares used by rules.

    Null, empty and blank texts have no words and zero counts. Everything is computed in the row;
    sorting replaces pairwise comparison, so a text of n words costs n log n. Existing columns of the
    result names are replaced.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *FEATURES)
    d = df.select(*[c for c in df.columns if c.lower() not in made])
    t = F.coalesce(F.col(text), F.lit(""))
    n_chars = F.greatest(F.char_length(t), F.lit(1))
    gone = lambda chars: F.char_length(t) - F.char_length(F.regexp_replace(t, f"[{chars}]+", ""))
    d = d.withColumn("w_", words(F.col(text))).withColumn("l_", F.filter(
        F.split(t, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r")) != ""))
    d = d.withColumns({
        "n_words": F.size("w_").cast("long"), "n_lines_": F.size("l_"),
        "word_chars": F.char_length(F.array_join("w_", "")).cast("long"),
        "n_symbols": gone("#*$%&|<>").cast("long"),
        "n_dup_lines": (F.size("l_") - F.size(F.array_distinct("l_"))).cast("long"),
        "distinct_share": F.size(F.array_distinct("w_")) / F.greatest(F.size("w_"), F.lit(1)),
        "upper_share": gone("A-Z") / n_chars, "digit_share": gone("0-9") / n_chars, "mark_share": gone("!?") / n_chars,
        "h_": F.transform("w_", lambda x: F.xxhash64(x))}).drop("w_", "l_")
    for step in (1, 2, 4):
        d = d.withColumn("h_", F.zip_with("h_", F.slice("h_", step + 1, F.size("h_")), lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b))))
    d = d.withColumn("h_", F.slice("h_", 1, F.greatest(F.col("n_words").cast("int") - (SPAN - 1), F.lit(0))))
    # Only texts with an equal pair of windows go on; the others keep null.
    d = d.withColumn("h_", F.when(F.size(F.array_distinct("h_")) < F.size("h_"), F.array_sort(
        F.transform("h_", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    d = d.withColumn("eq_", F.zip_with("h_", F.slice("h_", 2, F.size("h_")), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))))
    twice = F.zip_with("eq_", F.concat(F.array(F.lit(False)), F.col("eq_")), lambda a, b: F.coalesce(a, F.lit(False)) | b)
    at = F.array_sort(F.array_compact(F.zip_with("h_", twice, lambda a, f: F.when(f, a["i"]))))
    zero = F.struct(F.lit(0).alias("e"), F.lit(0).alias("n"))
    covered = F.aggregate(at, zero, lambda s, i: F.struct((i + SPAN).alias("e"), (s["n"] + i + SPAN - F.greatest(s["e"], i)).alias("n")))["n"]
    d = d.withColumn("n_repeat_words", F.coalesce(F.when(F.col("h_").isNotNull(), covered), F.lit(0)).cast("long")).drop("h_", "eq_")
    some = F.greatest("n_words", F.lit(1))
    return d.withColumns({
        "base_failed": (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")),
        "mean_word": F.col("word_chars") / some, "symbol_share": F.col("n_symbols") / n_chars,
        "dup_line_share": F.col("n_dup_lines") / F.greatest("n_lines_", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / some}).drop("n_lines_")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, sign, threshold): sign '>' or '<='. It rejects what meets all."""

    conditions: tuple[tuple[str, str, float], ...]

    def covers(self, x: dict) -> bool:
        return all((x[f] > v) if s == ">" else (x[f] <= v) for f, s, v in self.conditions)

    def column(self) -> Column:
        out = F.lit(True)
        for f, s, v in self.conditions:
            out = out & ((F.col(f) > v) if s == ">" else (F.col(f) <= v))
        return out


def _best_condition(bad: list[dict], good: list[dict]) -> tuple[float, tuple[str, str, float] | None]:
    """The threshold with the highest FOIL gain; every seen value of every feature is tried."""
    base = math.log2(len(bad) / (len(bad) + len(good)))
    best: tuple[float, tuple[str, str, float] | None] = (1e-9, None)
    for f in FEATURES:
        marked = sorted([(r[f], 1) for r in bad] + [(r[f], 0) for r in good])
        p = n = 0
        for k, (v, is_bad) in enumerate(marked):
            p, n = p + is_bad, n + 1 - is_bad
            if k + 1 < len(marked) and marked[k + 1][0] == v:
                continue
            for sign, a, b in (("<=", p, n), (">", len(bad) - p, len(good) - n)):
                if a and (gain := a * (math.log2(a / (a + b)) - base)) > best[0]:
                    # Half way to the next value, so that unseen rows fall on the nearer side.
                    best = (gain, (f, sign, (v + marked[k + 1][0]) / 2 if k + 1 < len(marked) else v))
    return best


def _grow(bad: list[dict], good: list[dict], most: int) -> Rule:
    conds: list[tuple[str, str, float]] = []
    while bad and good and len(conds) < most:
        _, c = _best_condition(bad, good)
        if c is None:
            break
        conds.append(c)
        r = Rule((c,))
        bad, good = [x for x in bad if r.covers(x)], [x for x in good if r.covers(x)]
    return Rule(tuple(conds))


def _precision(rule: Rule, bad: list[dict], good: list[dict]) -> tuple[float, int]:
    p, n = sum(map(rule.covers, bad)), sum(map(rule.covers, good))
    return (p / (p + n) if p + n else 0.0), p


def learn_rules(rows: list[dict], precision: float = 0.9, most_rules: int = 8, most_conditions: int = 4, least_covered: int = 3) -> list[Rule]:
    """Ordered rejecting rules from rows with ``FEATURES``, ``fold`` (0..2; 2 prunes) and ``quality`` (0 is rejected)."""
    split = lambda q, prune: [r for r in rows if r["quality"] == q and (r["fold"] == 2) == prune]
    bad, good, bad_p, good_p = split(0, False), split(1, False), split(0, True), split(1, True)
    rules: list[Rule] = []
    while bad and len(rules) < most_rules:
        rule = _grow(bad, good, most_conditions)
        if not rule.conditions:
            break
        # Of the rule's leading parts, the one with the best worth on the pruning rows; short ones first.
        def worth(k: int, conditions=rule.conditions) -> float:
            part = Rule(conditions[:k])
            p, n = sum(map(part.covers, bad_p)), sum(map(part.covers, good_p))
            return (p - n) / (p + n) if p + n else -1.0
        rule = Rule(rule.conditions[:max(range(1, len(rule.conditions) + 1), key=lambda k: (worth(k), -k))])
        share, n = _precision(rule, bad_p, good_p)
        if share < precision or n < least_covered:
            break
        rules.append(rule)
        bad, good = [x for x in bad if not rule.covers(x)], [x for x in good if not rule.covers(x)]
        bad_p, good_p = [x for x in bad_p if not rule.covers(x)], [x for x in good_p if not rule.covers(x)]
    return rules


def training_rows(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
                  sample_rows: int = SAMPLE_ROWS) -> list[dict]:
    """Statistics of at most ``sample_rows`` labelled rows, chosen by hash; null labels and keys are left out."""
    want = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k_"), F.col(label).cast("int").alias("quality"))
    want = bounded_sample(want, "k_", sample_rows)
    d = docs.select(F.col(key).alias("k_"), F.col(text).alias("t_")).join(F.broadcast(want), "k_")  # bounded by sample_rows
    d = statistics(d, "t_").select("k_", "quality", (F.abs(F.hash("k_")) % 3).alias("fold"), *FEATURES)
    return [r.asDict() for r in d.orderBy("k_", "quality").limit(2 * sample_rows).collect()]


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: false for the first rule that covers a row, else true."""
    out = None
    for r in rules:
        out = F.when(r.column(), False) if out is None else out.when(r.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


@other_columns_aside("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *FEATURES)
def apply_rules(df: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``df`` with its statistics and ``kept``: false where base_failed or a rule rejects."""
    s = statistics(df.drop(*[c for c in df.columns if c.lower() == "kept"]), text)
    return s.withColumn("kept", ~F.col("base_failed") & verdict(rules))
