"""Token counts of whole texts for a byte-pair vocabulary file.

Pre-tokens are held as one flat symbol array with sequence borders (a ragged array). Each step
looks up the rank of every adjacent pair, takes each sequence's lowest rank and merges all its
places at once; sequences without a mergeable pair leave with the number of symbols left.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import own_name

NO_RANK = np.iinfo(np.int64).max
#: Counts of so many distinct white-space pieces are remembered by a worker before it starts anew.
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Merges:
    """Ranks of symbol pairs as sorted arrays, and the symbols of single bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, names = spec["model"], byte_symbols()
        vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.last = np.array([vocab[c + self.end] for c in names], np.int64)
        self.width = max(vocab.values()) + 1
        left, right = zip(*(m if isinstance(m, list) else m.split(" ") for m in model["merges"]), strict=True)
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in zip(left, right, strict=True)], np.int64)
        made = np.array([vocab[a + b] for a, b in zip(left, right, strict=True)], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """Symbols left of each non-empty piece after all merges."""
        out = np.zeros(len(pieces), np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        seq = np.repeat(np.arange(len(pieces)), sizes)
        sym = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.last[flat[ends]]
        while len(sym):
            same = seq[1:] == seq[:-1]
            key = np.where(same, sym[:-1] * self.width + sym[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.ranks[at], NO_RANK), NO_RANK)
            first = np.flatnonzero(np.append(True, ~same))
            low = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            done = low == NO_RANK
            out[seq[first[done]]] = length[done]
            low_at = np.repeat(low, length)
            hit = (rank == low_at) & (low_at != NO_RANK)
            # A pair of equal symbols can overlap itself: of a run of hits take every second one.
            spots = np.flatnonzero(hit)
            if len(spots):
                start = np.append(True, np.diff(spots) > 1)
                run = spots[start][np.cumsum(start) - 1]
                spots = spots[(spots - run) % 2 == 0]
                sym[spots] = self.made[at[spots]]
            keep = np.repeat(~done, length)
            keep[spots + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


class Counter:
    """Counts tokens of texts as the vocabulary file's own library does by default."""

    def __init__(self, path: str):
        self.merges, self.known = merges(path), {}
        self.special = regex.compile("|".join(map(regex.escape, self.merges.specials)))

    def chunks(self, text: str) -> tuple[list[str], int]:
        """White-space pieces of the normalised text, and how many special strings it held."""
        n_special = 0
        if "<|" in text and (n_special := len(self.special.findall(text))):
            text = self.special.sub(" ", text)
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        if regex.search(r"[\x1c-\x1f]", text):  # Python splits here, the vocabulary's rules do not
            return [c for c in regex.split(r"\p{White_Space}+", text) if c], n_special
        return text.split(), n_special

    def learn(self, new: set[str]) -> None:
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known = {}
        chunk_list, pieces = list(new), []
        owner = []
        index: dict[str, int] = {}
        for k, c in enumerate(chunk_list):
            for p in self.merges.pieces.findall(c):
                owner.append((k, index.setdefault(p, len(index))))
        pieces = [p.encode("utf-8", "surrogatepass") for p in index]
        totals = np.zeros(len(chunk_list), np.int64)
        if owner:
            o = np.array(owner)
            np.add.at(totals, o[:, 0], self.merges.count(pieces)[o[:, 1]])
        self.known.update(zip(chunk_list, totals.tolist(), strict=True))

    def __call__(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        for at in range(0, len(texts), 64):
            split = [self.chunks(t or "") for t in texts[at:at + 64]]
            # One text at a time may exceed the cache, so what a text needs is held until it is counted.
            new = set().union(*(c for c, _ in split)) - self.known.keys()
            if new:
                if len(self.known) + len(new) > CACHE_WORDS:
                    self.known, new = {}, set().union(*(c for c, _ in split))
                self.learn(new)
            for k, (c, n) in enumerate(split):
                out[at + k] = sum(map(self.known.__getitem__, c)) + n
        return out


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 2048) -> DataFrame:
    """``df`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``) of each whole text.

    ``path`` is a byte-level BPE file of the tokenizers library; special strings inside a text
    count as one token each (the library's default), none are added. Null and empty texts have
    0 bytes and 0 tokens. Repeated rows are counted each; an empty table gives an empty result;
    existing columns of the three names are replaced. One narrow pass, no shuffle: a lost task
    is simply run again.
    """
    keep = [c for c in df.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    tmp = own_name(df, "_text")
    src = df.select(*keep, F.col(text).alias(tmp)) if keep else df.select(F.col(text).alias(tmp))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != tmp),
                        "n_bytes bigint", "n_tokens bigint", "over_limit boolean"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            texts = b.column(tmp).to_pylist()
            n = np.array(counter(texts), np.int64)
            size = np.array([len(t.encode("utf-8", "surrogatepass")) if t else 0 for t in texts], np.int64)
            cols = [b.column(k) for k in range(b.num_columns - 1)] + [pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    return src.mapInArrow(run, schema)
