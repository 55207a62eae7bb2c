"""Preference learning over every labelled row: pairs against brute force, no row left out."""

import numpy as np
from pyspark.sql import functions as F

from wardlens.llm import quality_classifier as qc

from .util import frame


def test_every_labelled_row_is_learned_from(spark):
    n = 12_500  # more than any sample that was once drawn
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.expr("repeat(concat('word', id % 97, ' '), 1 + id % 5)").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 97 < 60).cast("int").alias("quality"))
    got = qc.train(docs, labels)
    x = np.array([qc.text_features(f"word{i % 97} " * (1 + i % 5)) for i in range(n)])
    np.testing.assert_allclose(got.mean, x.mean(0), atol=1e-9)
    np.testing.assert_allclose(got.scale, x.std(0) + 1e-6, atol=1e-9)
    s = np.sort(np.clip((x - got.mean) / got.scale, -8, 8) @ got.weights)
    k = sum(i % 97 >= 60 for i in range(n))
    assert abs(got.cut - (s[k - 1] + s[k]) / 2) < 1e-9


def test_weights_equal_those_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    x, good = rng.normal(size=(120, qc.N_FEATURES)), rng.random(120) < 0.6
    x[good, 0] += 1.0
    rows = spark.createDataFrame([(bool(g), v.tolist()) for g, v in zip(good, x, strict=True)], "good boolean, x array<double>")
    got = qc.fit(rows)
    z = qc.normal(x, x.mean(0), x.std(0) + 1e-6)
    d = (z[good][:, None, :] - z[~good][None, :, :]).reshape(-1, qc.N_FEATURES)
    w = np.zeros(qc.N_FEATURES)
    for _ in range(25):
        p = 1 / (1 + np.exp(-(d @ w)))
        w = w + np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + 1e-3 * np.eye(len(w)), d.T @ (1 - p) / len(d) - 1e-3 * w)
    np.testing.assert_allclose(got.weights, w, atol=0.02)


def test_middle_of_ties_and_of_odd_values(spark):
    for values in ([1.0, 1.0, 1.0], [3.0, -1.0, 2.0, 2.0, 7.5], [0.0, 1e-300, 1e9, 1e9 + 1], [5.0, 6.0]):
        df, s = spark.createDataFrame([(v,) for v in values], "v double"), sorted(values)
        assert [qc.middle(df, "v", k) for k in range(1, len(s))] == [(s[k - 1] + s[k]) / 2 for k in range(1, len(s))]


def test_one_class_and_no_rows(spark):
    df = frame(spark, [(1, "a b"), (2, "c"), (None, "d")])
    labels = spark.createDataFrame([(1, 1), (2, 1), (None, 0)], "doc_id long, quality int")
    assert qc.train(df, labels).cut == -1.0 and qc.train(df, labels.limit(0)).cut == 1.0
