"""Each stage against brute force on the stage's own input, and the whole run."""

from collections import Counter

import corpus_pipeline
import pytest
from wardlens import session
from wardlens.llm import quality_rules

from .test_dedup import brute_groups
from .test_scores import stats
from .test_tables import brute_marks
from .util import frame, odd_rows

SF = "/root/testdata/sf0.01"


def bag(df):
    return Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect())


@pytest.fixture(scope="module")
def steps(spark):
    """Input of each stage, then the result."""
    docs = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        docs.append(corpus_pipeline.store(stage(spark, docs[-1], SF), name))
    return docs


def test_quality_stage(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rules = quality_rules.learn_rules(quality_rules.training_rows(steps[0], labels))
    shares = {r.doc_id: r.asDict() for r in quality_rules.statistics(steps[0]).collect()}
    want = Counter({k: n for k, n in bag(steps[0]).items() if not stats(k[1])[-1] and not any(r.covers(shares[k[0]]) for r in rules)})
    assert bag(steps[1]) == want and sum(want.values()) < steps[0].count()


def test_near_dedup_stage(steps):
    rows = bag(steps[1])
    group = brute_groups([(k[0], k[1]) for k in rows])
    assert bag(steps[2]) == Counter({k: n for k, n in rows.items() if group[k[0]] == k[0]})


def test_decontaminate_stage(spark, steps):
    rows = bag(steps[2])
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r[0] for r in brute_marks([k[:2] for k in rows], bench) if r[-1]}
    assert bad and bag(steps[3]) == Counter({k: n for k, n in rows.items() if k[0] not in bad})


def test_mix_stage(steps):
    before, after = bag(steps[3]), bag(steps[4])
    assert steps[4].columns == steps[0].columns and all(k in before and n <= 2 for k, n in after.items())
    size, taken = Counter(), Counter()
    for k in before:
        size[k[3]] += len(k[1].split())
    for k, n in after.items():
        taken[k[3]] += n * len(k[1].split())
    most = max(len(k[1].split()) for k in before)
    assert all(taken[s] <= 2 * size[s] for s in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= len(size) * most / 2


def test_shard_stage(steps):
    rows = steps[5].collect()
    assert bag(steps[5].select(*steps[0].columns)) == bag(steps[4])
    counts = Counter(r.shard for r in rows)
    assert len(counts) == 16 and max(counts.values()) - min(counts.values()) <= 1
    assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(16) for k in range(counts[s])]


def test_run_repeats_the_stages(spark, steps):
    key = lambda df: Counter((r.doc_id, r.shard, r.slot) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])


def test_run_leaves_only_its_result(spark):
    before = len(session.WRITTEN)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len(session.WRITTEN) == before + 1 and out.count() > 0 and "wardlens-shard-" in out.inputFiles()[0]


@pytest.mark.parametrize("rows", [[], odd_rows()])
def test_stages_on_odd_tables(spark, rows):
    docs = frame(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.columns[:5] == docs.columns
        assert out.count() <= 2 * len(rows)
