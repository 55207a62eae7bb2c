"""Language of texts by a small byte convolutional network, trained and run in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, the largest
response of each filter goes through softmax. A text is cut into windows of WINDOW bytes, all of them are
scored in batches, and their logits are averaged by length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import bounded_sample, hash60, own_name

#: Labelled rows used for learning, at most (one window of each).
SAMPLE_ROWS = 6_000
WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 16, 8
REACH = max(WIDTHS)


@dataclass(frozen=True)
class Model:
    """``tables[j]`` is what the byte at offset j adds to every filter (embedding times weights)."""

    langs: list[str]
    tables: np.ndarray    # REACH x 256 x filters
    bias: np.ndarray
    out: np.ndarray       # filters x langs
    out_bias: np.ndarray

    def logits(self, windows: np.ndarray) -> np.ndarray:
        """windows: n x (WINDOW + REACH - 1) bytes, zero padded."""
        n, length = windows.shape[0], windows.shape[1] - REACH + 1
        conv = np.take(self.tables[0], windows[:, :length], axis=0)
        for j in range(1, REACH):
            conv += np.take(self.tables[j], windows[:, j:j + length], axis=0)
        return np.maximum(conv.max(axis=1) + self.bias, 0) @ self.out + self.out_bias


def cut(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Zero-padded windows of a text's bytes and their lengths; they overlap by the filters' reach."""
    n = max(1, -(-len(raw) // WINDOW))
    flat = np.zeros(n * WINDOW + REACH - 1, np.uint8)
    flat[:len(raw)] = np.frombuffer(raw, np.uint8)
    rows = np.lib.stride_tricks.sliding_window_view(flat, WINDOW + REACH - 1)[::WINDOW]
    size = np.full(n, WINDOW, np.float64)
    size[-1] = len(raw) - WINDOW * (n - 1)
    return rows, size


def fit(texts: list[bytes], langs: list[str], epochs: int = 4, rate: float = 3e-3, batch: int = 64, seed: int = 1) -> Model:
    """Adam on the cross-entropy of single windows, classes weighted by the root of their rarity."""
    names = sorted(set(langs))
    x = np.concatenate([cut(t)[0][:1] for t in texts])
    y = np.searchsorted(names, langs)
    weight = (1 / np.sqrt(np.bincount(y, minlength=len(names))))[y]
    weight = weight / weight.mean()
    rng = np.random.default_rng(seed)
    par = {"e": rng.normal(0, 0.5, (256, EMBED)), "ob": np.zeros(len(names)), "o": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names)))}
    for k in WIDTHS:
        par[f"w{k}"], par[f"b{k}"] = rng.normal(0, (2 / (k * EMBED)) ** 0.5, (k * EMBED, FILTERS)), np.zeros(FILTERS)
    par = {k: v.astype(np.float32) for k, v in par.items()}
    m1, m2, t = {k: np.zeros_like(v) for k, v in par.items()}, {k: np.zeros_like(v) for k, v in par.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at:at + batch]
            xb, n = x[pick], len(pick)
            emb = par["e"][xb]
            pooled, back = [], []
            for k in WIDTHS:
                cols = np.concatenate([emb[:, j:j + WINDOW] for j in range(k)], axis=2)
                conv = cols.reshape(-1, k * EMBED) @ par[f"w{k}"]
                conv = conv.reshape(n, WINDOW, FILTERS)
                top = conv.argmax(axis=1)
                pooled.append(np.take_along_axis(conv, top[:, None, :], axis=1)[:, 0] + par[f"b{k}"])
                back.append((k, cols, top))
            z = np.concatenate(pooled, axis=1)
            act = np.maximum(z, 0)
            logit = act @ par["o"] + par["ob"]
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y[pick]] -= 1
            p *= (weight[pick] / n)[:, None].astype(np.float32)
            grad = {"o": act.T @ p, "ob": p.sum(0), "e": np.zeros_like(par["e"])}
            dz = (p @ par["o"].T) * (z > 0)
            for i, (k, cols, top) in enumerate(back):
                g = dz[:, i * FILTERS:(i + 1) * FILTERS]
                best = cols[np.arange(n)[:, None], top]                       # n x filters x k*embed
                grad[f"w{k}"] = np.einsum("nf,nfc->cf", g, best)
                grad[f"b{k}"] = g.sum(0)
                d_cols = g[:, :, None] * par[f"w{k}"].T[None]                 # n x filters x k*embed
                for j in range(k):
                    bytes_at = xb[np.arange(n)[:, None], top + j]
                    np.add.at(grad["e"], bytes_at.ravel(), d_cols[:, :, j * EMBED:(j + 1) * EMBED].reshape(-1, EMBED))
            t += 1
            for name, g in grad.items():
                m1[name] = 0.9 * m1[name] + 0.1 * g
                m2[name] = 0.999 * m2[name] + 0.001 * g * g
                par[name] -= (rate * (m1[name] / (1 - 0.9**t)) / (np.sqrt(m2[name] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    tables = np.zeros((REACH, 256, FILTERS * len(WIDTHS)), np.float32)
    for i, k in enumerate(WIDTHS):
        for j in range(k):
            tables[j, :, i * FILTERS:(i + 1) * FILTERS] = par["e"] @ par[f"w{k}"][j * EMBED:(j + 1) * EMBED]
    return Model(names, tables, np.concatenate([par[f"b{k}"] for k in WIDTHS]), par["o"], par["ob"])


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fits on one window of each of at most ``sample_rows`` rows with text and lang (smallest hash
    of the key); the window's place in the text is drawn by hash. None without such rows."""
    t = F.col(text)
    start = F.pmod(hash60(F.col(key), seed=9), F.greatest(F.char_length(t) - WINDOW, F.lit(1))).cast("int") + 1
    d = docs.where(t.isNotNull() & (t != "") & F.col(lang).isNotNull()).select(
        F.col(key).alias("k_"), F.col(lang).alias("lang_"), F.substring(t, start, F.lit(WINDOW)).alias("t_"))
    rows = bounded_sample(d, "k_", sample_rows).collect()
    rows.sort(key=lambda r: (r.k_ is None, r.k_, r.lang_, r.t_))
    return fit([r.t_.encode("utf-8", "surrogatepass")[:WINDOW] for r in rows], [r.lang_ for r in rows]) if rows else None


def predict(texts: list[str | None], model: Model | None, most: int = 64) -> tuple[list[str], np.ndarray]:
    """Language and probability of each whole text; ``und`` and 0 for null and letterless texts."""
    names, score = ["und"] * len(texts), np.zeros(len(texts))
    if model is None:
        return names, score
    live = [k for k, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    total, weight = np.zeros((len(texts), len(model.langs))), np.zeros(len(texts))
    rows, sizes, owner, held = [], [], [], 0

    def flush() -> None:
        nonlocal rows, sizes, owner, held
        if held:
            win, size, own = np.concatenate(rows), np.concatenate(sizes), np.concatenate(owner)
            for at in range(0, len(win), most):
                part = slice(at, at + most)
                np.add.at(total, own[part], model.logits(win[part]) * size[part, None])
            np.add.at(weight, own, size)
        rows, sizes, owner, held = [], [], [], 0

    for k in live:
        w, s = cut(texts[k].encode("utf-8", "surrogatepass"))
        rows.append(w), sizes.append(s), owner.append(np.full(len(s), k))
        held += len(s)
        if held >= 16 * most:
            flush()
    flush()
    if live:
        z = total[live] / weight[live, None]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        for k, best, s in zip(live, p.argmax(1), p.max(1), strict=True):
            names[k], score[k] = model.langs[best], s
    return names, score


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with lang_pred and score (0 to 1) of each whole text; ``und`` and 0 where the text is null or has no letter.

    One narrow pass; repeated rows are scored each; existing columns of the two names are replaced.
    """
    keep = [c for c in df.columns if c.lower() not in ("lang_pred", "score")]
    tmp = own_name(df, "_text")
    src = df.select(*keep, F.col(text).alias(tmp))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != tmp), "lang_pred string", "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, score = predict(b.column(tmp).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 1)), pa.array(names), pa.array(score)], names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(run, schema)
