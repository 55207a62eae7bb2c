"""Quality scores learned from preference pairs (Bradley-Terry).

A good document is preferred to a bad one; the log-odds of this are the difference of their scores, and a score
is linear in text features. The weights minimise the logistic loss of feature differences over all
pairs of a good and a bad labelled row; the cut between good and bad is a quantile of the scores of all labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import own_name, store

N_FEATURES = 14
#: Scores of one bin meet the other class's bins at their mean; bins reach from -REACH to REACH, the outer ones are open.
BINS, REACH = 512, 32.0
#: Newton steps at most, and the change of the weights that ends them.
STEPS, TOLERANCE = 12, 1e-3
#: Bins of one pass for the quantile.
QUANTILE_BINS = 2048

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1                                    # A-Z
_CLASS[48:58] = 2                                    # digits
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 3             # symbols
_CLASS[[ord(c) for c in "!?"]] = 4
_CLASS[[ord(c) for c in ".,;:'\"()-"]] = 5
_CLASS[[9, 11, 12, 13, 32]] = 6
_CLASS[10] = 7


def text_features(text: str | None) -> np.ndarray:
    """Bounded features of a whole text; all zero but the constant shares for an empty one."""
    x = np.zeros(N_FEATURES)
    if not text:
        return x
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    freq = np.bincount(raw, minlength=256)
    x[:7] = np.bincount(_CLASS, weights=freq, minlength=8)[1:] / len(raw)
    p = freq[freq > 0] / len(raw)
    x[7] = -(p * np.log2(p)).sum() / 8
    w = text.split()
    if w:
        x[8] = np.log1p(len(w)) / 12
        x[9] = len(set(w)) / len(w)
        x[10] = min(1.0, sum(map(len, w)) / len(w) / 20)
        x[11] = sum(map(eq, w, w[1:])) / len(w)
        lines = [s for s in text.split("\n") if s.strip()]
        x[12] = 1 - len(set(lines)) / len(lines) if lines else 0.0
        x[13] = min(1.0, len(w) / (len(set(w)) ** 1.2 + 1) / 20)
    return x


@dataclass(frozen=True)
class Ranker:
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) - self.cut, -30, 30)))


def normal(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -8, 8)


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES)


_SUMS = 1 + N_FEATURES + N_FEATURES * N_FEATURES


def bin_sums(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, w: np.ndarray) -> np.ndarray:
    """(2, BINS, _SUMS): of the bad and good rows (good, x) in each score bin their number, the sum of z and that of z z'."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2 * BINS, _SUMS))
        for b in batches:
            z = normal(matrix(b.column("x")), mean, scale)
            place = np.clip(np.floor((z @ w + REACH) * (BINS / (2 * REACH))), 0, BINS - 1).astype(np.int64)
            place += BINS * b.column("good").to_numpy(zero_copy_only=False).astype(np.int64)
            for i, v in enumerate([None, *z.T, *(z[:, j] * z[:, k] for j in range(N_FEATURES) for k in range(N_FEATURES))]):
                total[:, i] += np.bincount(place, weights=v, minlength=2 * BINS)
        flat = total.reshape(-1)
        used = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(flat[used])], names=["cell", "v"])

    # At most 2 * BINS * _SUMS cells, whatever the rows.
    cells = rows.mapInArrow(run, "cell long, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(2 * BINS * _SUMS)
    out[cells.column("cell").to_numpy()] = cells.column("v").to_numpy()
    return out.reshape(2, BINS, _SUMS)


def newton_step(sums: np.ndarray, w: np.ndarray, penalty: float) -> np.ndarray:
    """Step of the mean logistic loss over all pairs of a good and a bad row, from the sums of their bins."""
    (nd, zd, md), (nu, zu, mu) = ((s[:, 0], s[:, 1:1 + N_FEATURES], s[:, 1 + N_FEATURES:]) for s in (c[c[:, 0] > 0] for c in sums))
    p = 1 / (1 + np.exp(-np.clip((zu @ w / nu)[:, None] - (zd @ w / nd)[None, :], -30, 30)))
    pairs, q, r = nu.sum() * nd.sum(), 1 - p, p * (1 - p)
    grad = (zu.T @ (q @ nd) - zd.T @ (q.T @ nu)) / pairs - penalty * w
    cross = zu.T @ r @ zd
    square = (mu.T @ (r @ nd) + md.T @ (r.T @ nu)).reshape(N_FEATURES, N_FEATURES)
    return np.linalg.solve((square - cross - cross.T) / pairs + penalty * np.eye(N_FEATURES), grad)


def middle(rows: DataFrame, value: str, k: int) -> float:
    """Halfway between the k-th smallest value and the next one (k from 1, and below the number of rows).

    Each pass counts the values of the range that is left in bins; the bin with the place sought is the next range.
    """
    lo, hi = rows.agg(F.min(value), F.max(value)).first()
    v, place, below = F.col(value), k, 0
    while lo < hi:
        bucket = F.least(F.floor((v - F.lit(lo)) / F.lit(hi - lo) * QUANTILE_BINS), F.lit(QUANTILE_BINS - 1))
        bins = rows.where(v.between(lo, hi)).groupBy(bucket.alias("b")).agg(F.count(v).alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        for r in sorted(bins.collect()):
            if place < below + r.n:
                lo, hi = r.lo, r.hi
                break
            below += r.n
    if below < k:  # the k-th value equals the next one
        return lo
    return (rows.where(v < lo).agg(F.max(v)).first()[0] + lo) / 2


def fit(rows: DataFrame, penalty: float = 1e-3) -> Ranker:
    """Weights by Newton steps on the logistic loss of all pairs of the rows (good, x); cut at the quantile of the bad share.

    A step is one pass over the rows, which leaves sums for each class and score bin. With one class only there
    is no pair: all rows score as that class.
    """
    x = [F.col("x")[i] for i in range(N_FEATURES)]
    first = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x]).first()
    n, good = first[0], first[1]
    if good in (0, n):
        side = -1.0 if n and good == n else 1.0
        return Ranker(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), side)
    # Rounded: the order in which tasks end must not show in the scores.
    mean, scale = np.round(first[2:2 + N_FEATURES], 12), np.round(first[2 + N_FEATURES:], 12) + 1e-6
    w = np.zeros(N_FEATURES)
    for _ in range(STEPS):
        step = newton_step(bin_sums(rows, mean, scale, w), w, penalty)
        w = w + step
        if np.abs(step).max() < TOLERANCE:
            break
    w = np.round(w, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(normal(matrix(b.column("x")), mean, scale) @ w)], names=["raw"])

    # Between the two scores around the quantile, so that ties at the border stay on one side.
    return Ranker(w, mean, scale, middle(rows.mapInArrow(run, "raw double"), "raw", n - good))


def _features(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    tmp = own_name(df, "_text")
    src = df.select(*keep, F.col(text).alias(tmp))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != tmp), "x array<double>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [text_features(t) for t in b.column(tmp).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(x, pa.list_(pa.float64()))], names=[*keep, "x"])

    return src.mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Ranker:
    """Fits on every labelled row; null labels and keys are left out.

    The features, not the texts, meet the labels, and are written once for the passes of the fit.
    """
    want = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k_"), (F.col(label) == 1).alias("good"))
    d = docs.where(F.col(key).isNotNull()).select(F.col(key).alias("k_"), F.col(text).alias("t_"))
    return fit(store(_features(d, "t_", ["k_"]).join(want, "k_").select("good", "x"), "preferences"))


def score(df: DataFrame, ranker: Ranker, text: str = "text") -> DataFrame:
    """``df`` with score (0 to 1) and predicted (1 if score >= 0.5) of each whole text.

    Null and empty texts have zero features and get a score like any other. One narrow pass;
    repeated rows are scored each; existing columns of the two names are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in ("score", "predicted")]
    tmp = own_name(df, "_text")
    src = df.select(*keep, F.col(text).alias(tmp))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != tmp), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([text_features(t) for t in b.column(tmp).to_pylist()]).reshape(-1, N_FEATURES)
            s = ranker.score(np.clip(x, ranker.mean - 8 * ranker.scale, ranker.mean + 8 * ranker.scale))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(s), pa.array((s >= 0.5).astype(np.int32))],
                                             names=[*keep, "score", "predicted"])

    return src.mapInArrow(run, schema)
