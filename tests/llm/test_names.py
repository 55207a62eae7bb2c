"""Extra columns with the names that operators use inside come through unharmed."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from wardlens import llm
from wardlens.llm import decontam, line_dedup, minhash, mixing, quality_rules, sharding, suffix_dedup

from .util import BASE, frame

ROWS = [(1, BASE + "\nline one of it\nline one of it"), (2, BASE + "\nanother line here"), (3, None), (4, "x $ y"), (4, "x $ y")]
RULE = [quality_rules.Rule((("symbol_share", ">", 0.1),))]


def bench(df):
    return df.sparkSession.createDataFrame([(1, "quick brown fox")], "item_id long, text string")


OPERATORS = {"suffix_dedup": suffix_dedup.dedup_substrings, "minhash": minhash.drop_near_duplicates, "line_dedup": line_dedup.dedup_lines, "mixing": mixing.mix,
             "sharding": sharding.shard, "quality_rules": lambda df: quality_rules.apply_rules(df, RULE),
             "decontam": lambda df: decontam.decontaminate(df, bench(df)), "decontam spans": lambda df: decontam.decontaminate(df, bench(df), remove="spans")}


def inner_names(module):
    """Every word of the module and of the shared helpers that could be a column's name."""
    folder = Path(llm.__file__).parent
    text = (folder / f"{module}.py").read_text() + (folder / "common.py").read_text()
    return {n.lower() for n in re.findall(r"[\"'`]([A-Za-z_][A-Za-z_0-9]*)[\"'`]", text)} | {f"{n}__k" for n in ("one__", "s__", "b")}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_with_inner_names_are_kept(spark, name):
    plain = frame(spark, ROWS)
    want = OPERATORS[name](plain)
    made = {c.lower() for c in want.columns}
    extra = sorted(inner_names(name.split()[0]) - made - {c.lower() for c in plain.columns})
    assert len(extra) > 5
    full = plain.select("*", *[F.lit(i).alias(c) for i, c in enumerate(extra)])
    out = OPERATORS[name](full)
    assert sorted(out.columns) == sorted([*want.columns, *extra])
    got = out.collect()
    assert sorted(map(repr, ([r[c] for c in want.columns] for r in got))) == sorted(map(repr, (list(r) for r in want.collect())))
    assert all(r[c] == i for r in got for i, c in enumerate(extra))
