"""Exact substring deduplication by a depth-limited radix sort of suffixes.

Suffixes are ordered only as far as THRESHOLD bytes, digit by digit, most significant first, and a
group that lies in one document leaves after each pass. What is equal to the end is a repeated window.

Each window of THRESHOLD bytes is led by its anchor: of the DIGIT-byte strings in it, the one with the
smallest hash (the last of equals). The anchor depends on the window's bytes alone, so equal windows have equal
anchors at equal places, and all windows of a stretch share one anchor. Hence one record stands for the stretch
(16 windows on average), and the digits are: the anchor; the stretch; the single window.

Pass 1 groups records by anchor and, within it, by the bytes of the stretch. Of records with an equal stretch all but
those of the smallest document are repeated throughout. This is settled first within each map task, so of any
number of copies a task sends on one document's records. Only where an anchor has several stretches, pass 2
sorts the single windows of the smallest documents, whose bytes are then sent. The remaining bytes are joined back by document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlens.llm.common import other_columns_aside, store

THRESHOLD, DIGIT = 50, 20
REACH = THRESHOLD - DIGIT + 1
#: Windows worked on at once, and records that a map task settles among themselves at once.
CHUNK, HELD = 1 << 18, 200_000
#: Bytes of text whose records one reducing group gets, about.
BUCKET_BYTES = 6 << 20
_RNG = np.random.default_rng(20_01)
_BYTE = _RNG.integers(0, 1 << 64, 256, dtype=np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
BLOB = "bucket int, kind int, ids binary, prints binary, sizes binary, h binary, g binary, at binary, n binary, raw binary"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Prefix:
    """Hashes of any stretches of a buffer from prefix sums; equal bytes give equal hashes anywhere."""

    up, down = _powers(_ODD, 1), _powers(_INV, 1)

    def __init__(self, raw: np.ndarray):
        if len(Prefix.up) <= len(raw):
            Prefix.up, Prefix.down = _powers(_ODD, 2 * len(raw) + 1), _powers(_INV, 2 * len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * Prefix.down[:len(raw)], out=self.sums[1:])

    def __call__(self, at: np.ndarray, size) -> np.ndarray:
        return _mix((self.sums[at + size] - self.sums[at]) * Prefix.up[at] + np.uint64(1) * np.asarray(size).astype(np.uint64))

    def all(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * Prefix.up[:len(self.sums) - size] + np.uint64(size))


def stretches(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(piece, first window, windows, anchor hash, stretch hash) of all windows inside the pieces of a buffer."""
    if len(raw) < THRESHOLD:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    pre = Prefix(raw)
    x = pre.all(DIGIT)
    low = np.uint64((1 << 24) - 1)
    v = (x & ~low) | (low - np.arange(len(x), dtype=np.uint64))
    for step in (1, 2, 4, 8):
        v = np.minimum(v[:-step], v[step:])
    v = np.minimum(v[:len(v) - (REACH - 16)], v[REACH - 16:])
    anchor = (low - (v & low)).astype(np.int64)
    count = np.maximum(ends - starts - THRESHOLD + 1, 0)
    piece = np.repeat(np.arange(len(starts)), count)
    s = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(starts, count)
    a = anchor[s]
    first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (piece[1:] != piece[:-1]))) if len(a) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(a)))
    at = s[first]
    return piece[first], at, n, x[a[first]], pre(at, n + THRESHOLD - 1)


class Records:
    """Parallel arrays: document (id and print), place of the first window, windows, and two digit hashes."""

    def __init__(self, doc, fp, at, n, h, g):
        self.doc, self.fp, self.at, self.n, self.h, self.g = doc, fp, at, n, h, g

    def __len__(self):
        return len(self.doc)

    def take(self, k) -> Records:
        return Records(self.doc[k], self.fp[k], self.at[k], self.n[k], self.h[k], self.g[k])

    def order(self) -> Records:
        return self.take(np.lexsort((self.doc, self.g, self.h)))

    @staticmethod
    def join(parts: list[Records]) -> Records:
        return Records(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("doc", "fp", "at", "n", "h", "g")))


def settle(r: Records) -> tuple[Records, Records, np.ndarray]:
    """(repeated, rest, contested): records of ordered ``r`` with an equal stretch in a smaller document; the
    others; and which of these have an anchor that occurs in another document or stretch as well."""
    same_h = np.append(False, r.h[1:] == r.h[:-1])
    same = same_h & np.append(False, r.g[1:] == r.g[:-1])
    first = np.flatnonzero(~same)
    least = np.repeat(r.doc[first], np.diff(np.append(first, len(r))))
    gone = r.doc > least
    # Classes of an anchor: more than one, or not.
    group = np.cumsum(~same_h) - 1
    several = np.bincount(group, weights=~same) > 1
    rest = ~gone
    return r.take(gone), r.take(rest), several[group[rest]]


def merged(r: Records) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(doc, print, start, end) of the maximal byte runs that the records' windows cover."""
    r = r.take(np.lexsort((r.at, r.fp, r.doc)))
    if not len(r):
        return r.doc, r.fp, r.at, r.at
    end = r.at + r.n + THRESHOLD - 1
    new_doc = np.append(True, (r.doc[1:] != r.doc[:-1]) | (r.fp[1:] != r.fp[:-1]))
    # Ends rise within a document once each is at least the ends before it; offsets keep documents apart.
    base = (np.cumsum(new_doc) - 1).astype(np.float64) * float(end.max() + 1)
    reach = np.maximum.accumulate(base + end)
    fresh = new_doc | np.append(True, (base + r.at)[1:] > reach[:-1])
    k = np.flatnonzero(fresh)
    last = np.append(k[1:] - 1, len(r) - 1)
    return r.doc[k], r.fp[k], r.at[k], (reach[last] - base[last]).astype(np.int64)


def _planes(x: np.ndarray, low: type) -> bytes:
    """Integers as their low bytes followed by the rest, which is mostly zero and so compresses well."""
    bits = 8 * np.dtype(low).itemsize
    return x.astype(np.int64).astype(low).tobytes() + (x.astype(np.int64) >> bits).tobytes()


def _from_planes(raw: bytes, low: type) -> np.ndarray:
    wide = np.dtype(low).itemsize
    n = len(raw) // (wide + 8)
    return np.frombuffer(raw, low, n).astype(np.int64) + (np.frombuffer(raw, np.int64, n, n * wide) << (8 * wide))


def pack(r: Records, bucket: np.ndarray, kind: int) -> list[tuple]:
    """One row of binaries for each bucket. Records are in the order of the text, so ids and places shrink to
    differences and documents to counts. The upper half of the anchor's hash picks the bucket, the lower
    half travels, and 48 bits of the stretch's hash."""
    order = np.lexsort((r.at, r.fp, r.doc, bucket))
    r, bucket = r.take(order), bucket[order]
    out = []
    for part in np.split(np.arange(len(r)), np.flatnonzero(np.diff(bucket)) + 1):
        if len(part):
            p = r.take(part)
            new = np.flatnonzero(np.append(True, (p.doc[1:] != p.doc[:-1]) | (p.fp[1:] != p.fp[:-1])))
            step = np.diff(p.at, prepend=0)
            step[new] = p.at[new]
            out.append((int(bucket[part[0]]), kind, _planes(np.diff(p.doc[new], prepend=0), np.uint16), p.fp[new].tobytes(),
                        _planes(np.diff(np.append(new, len(p))), np.uint8), p.h.astype(np.uint32).tobytes(),
                        p.g.astype(np.uint32).tobytes() + (p.g >> np.uint64(32)).astype(np.uint16).tobytes(),
                        _planes(step, np.uint16), _planes(p.n, np.uint8), b""))
    return out


def unpack(row: dict) -> Records:
    sizes = _from_planes(row["sizes"], np.uint8)
    step = _from_planes(row["at"], np.uint16)
    total = np.cumsum(step)
    at = total - np.repeat((total - step)[np.cumsum(sizes) - sizes], sizes)
    n = len(step)
    g = np.frombuffer(row["g"], np.uint32, n).astype(np.uint64) + (np.frombuffer(row["g"], np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))
    return Records(np.repeat(np.cumsum(_from_planes(row["ids"], np.uint16)), sizes), np.repeat(np.frombuffer(row["prints"], np.int64), sizes), at,
                   _from_planes(row["n"], np.uint8), np.frombuffer(row["h"], np.uint32).astype(np.uint64), g)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True))
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 8]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[f.split(" ")[0] for f in BLOB.split(", ")])


def _send(held: list[Records], buckets: int) -> list[tuple]:
    """Settles a task's records among themselves and packs what others must see (kind 0) and what is decided (kind 1)."""
    repeated, rest, _ = settle(Records.join(held).order())
    rows = pack(rest, ((rest.h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64), 0)
    if len(repeated):
        doc, fp, start, end = merged(repeated)
        zero = np.zeros(len(doc), np.uint64)
        rows += pack(Records(doc, fp, start, end - start - THRESHOLD + 1, zero, zero), np.full(len(doc), int(doc[0]) % buckets), 1)
    return rows


def _pass1(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held, pieces, size = [], 0, [], 0

        def work() -> None:
            nonlocal n_held, pieces, size
            raw = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
            length = np.array([len(p[3]) for p in pieces])
            ends = np.cumsum(length)
            piece, at, n, h, g = stretches(raw, ends - length, ends)
            doc, fp, offset = (np.array([p[k] for p in pieces], np.int64) for k in range(3))
            held.append(Records(doc[piece], fp[piece], at - (ends - length)[piece] + offset[piece], n, h, g))
            n_held += len(n)
            pieces, size = [], 0

        for b in batches:
            for k in range(b.num_rows):  # one text at a time becomes a Python object
                doc, fp, text = (c[k].as_py() for c in b.columns)
                raw = text.encode("utf-8", "surrogatepass")
                for at in range(0, max(0, len(raw) - THRESHOLD + 1), CHUNK):
                    pieces.append((doc, fp, at, raw[at:at + CHUNK + THRESHOLD - 1]))
                    size += len(pieces[-1][3])
                    if size >= CHUNK:
                        work()
                if n_held >= HELD:
                    yield _batch(_send(held, buckets))
                    held, n_held = [], 0
        if pieces:
            work()
        if n_held:
            yield _batch(_send(held, buckets))

    return run


def _pass2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., doc, fp, text__, spots) to the bytes of contested stretches, one row for each document and bucket."""
    for b in batches:
        doc, fp, text, spots = (b.column(b.schema.get_field_index(c)) for c in ("doc", "fp", "text__", "spots"))
        rows, size = [], 0
        for k in range(b.num_rows):
            raw = text[k].as_py().encode("utf-8", "surrogatepass")
            s = spots[k].values
            bucket, at, n = (s.field(f).to_numpy(zero_copy_only=False) for f in ("bucket", "at", "n"))
            order = np.lexsort((at, bucket))
            bucket, at, n = bucket[order], at[order], n[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(bucket)) + 1):
                p, q = at[part], n[part]
                cut = b"".join(raw[i:i + m + THRESHOLD - 1] for i, m in zip(p.tolist(), q.tolist(), strict=True))
                rows.append((int(bucket[part[0]]), 0, np.int64(doc[k].as_py()).tobytes(), np.int64(fp[k].as_py()).tobytes(), b"", b"", b"",
                             p.astype(np.int64).tobytes(), q.astype(np.int64).tobytes(), cut))
                size += len(cut)
            if size > 2 << 20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _windows(rows: list[dict]) -> Records:
    """The single windows of contested stretches."""
    get = lambda f: np.concatenate([np.frombuffer(r[f], np.int64) for r in rows])
    at, n = get("at"), get("n")
    each = [len(r["at"]) // 8 for r in rows]
    raw = np.frombuffer(b"".join(r["raw"] for r in rows), np.uint8)
    length = n + THRESHOLD - 1
    start = np.cumsum(length) - length
    step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    pre, here = Prefix(raw), np.repeat(start, n) + step
    h = pre(here, THRESHOLD)
    g = _mix(pre(here, THRESHOLD // 2) ^ (pre(here + THRESHOLD // 2, THRESHOLD // 2) * _ODD))
    return Records(np.repeat(np.repeat(get("ids"), each), n), np.repeat(np.repeat(get("prints"), each), n), np.repeat(at, n) + step, np.ones(len(h), np.int64), h, g)


def _reduce(last: bool):
    """A bucket's records to (doc, fp, kind, a, b, bucket): removed bytes (kind 0: start, end) and contested
    stretches (kind 1: first window, windows)."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bucket, done, out = rows[0]["bucket"], [unpack(r) for r in rows if r["kind"] == 1], []
        if parts := [r for r in rows if r["kind"] == 0]:
            records = _windows(parts) if last else Records.join([unpack(r) for r in parts])
            del parts, rows
            records = records.order()
            repeated, rest, contested = settle(records)
            del records
            done.append(repeated)
            if not last:
                c = rest.take(contested)
                out.append((c.doc, c.fp, np.ones(len(c), np.int32), c.at, c.n))
        if done:
            doc, fp, start, end = merged(Records.join(done))
            out.append((doc, fp, np.zeros(len(doc), np.int32), start, end))
        names, kinds = ("doc", "fp", "kind", "a", "b"), (np.int64, np.int64, np.int32, np.int64, np.int64)
        cols = {n: np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, (n, t) in enumerate(zip(names, kinds, strict=True))}
        return pa.table(cols | {"bucket": np.full(len(cols["doc"]), bucket, np.int32)})

    return run


def _finish(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    """(..., text, spans) to (..., kept bytes, n_bytes, n_removed, spans)."""
    for b in batches:
        kept, size, gone, spans = [], [], [], []
        texts, marks = b.column(b.num_columns - 2), b.column(b.num_columns - 1)
        for k in range(b.num_rows):
            raw, runs, mark = (texts[k].as_py() or "").encode("utf-8", "surrogatepass"), [], marks[k].values
            for s, e in sorted(zip(mark.field("a").to_pylist(), mark.field("b").to_pylist(), strict=True)) if mark is not None else ():
                if runs and s <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], e)
                else:
                    runs.append([s, e])
            cut, at = [], 0
            for s, e in runs:
                cut.append(raw[at:s])
                at = e
            kept.append(b"".join([*cut, raw[at:]]))
            size.append(len(raw)), gone.append(len(raw) - len(kept[-1])), spans.append([{"start": s, "end": e} for s, e in runs])
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(b.num_columns - 2)), pa.array(kept, pa.binary()), pa.array(size, pa.int64()),
                                          pa.array(gone, pa.int64()), pa.array(spans, span), pa.array([hashlib.sha256(k).hexdigest() for k in kept])],
                                         names=[*keep, "kept", "n_bytes", "n_removed", "spans", "kept_sha256"])


@other_columns_aside("kept", "n_bytes", "n_removed", "spans", "kept_sha256")
def dedup_substrings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without its text, with kept (binary), n_bytes, n_removed, spans and kept_sha256.

    A byte goes if a THRESHOLD-byte string over it also starts in a document with a smaller key. Judged on
    the input; spans are the maximal removed runs (start, end). Null and empty texts have 0 bytes, texts
    shorter than THRESHOLD lose nothing, rows that repeat a key do not count for each other, and rows with a null key
    neither lose bytes nor count for others. Other columns are kept, but those of the result names are replaced.

    Digits are compared by hashes: 32 bits and the bucket for the anchor, whose collisions only add work, and 48
    further bits for a stretch; single windows by 128 bits.
    """
    made = ("kept", "n_bytes", "n_removed", "spans", "kept_sha256")
    keep = [c for c in df.columns if c != text and c.lower() not in made]
    ids = df.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("doc")).count()
    # Prints of the texts tell rows of one key apart; where keys are unique none are needed.
    on = ["doc"] if ids.where("count > 1").isEmpty() else ["doc", "fp"]
    docs = df.select(*[F.col(c).alias(f"{c}__in") for c in keep], F.col(key).cast("long").alias("doc"),
                     (F.xxhash64(F.col(text)) if len(on) > 1 else F.lit(0).cast("long")).alias("fp"), F.col(text).alias("text__"))
    able = F.col("doc").isNotNull() & (F.coalesce(F.octet_length("text__"), F.lit(0)) >= THRESHOLD)
    long_ = docs.where(able)
    total = long_.agg(F.sum(F.octet_length("text__").cast("long"))).first()[0] or 0
    buckets = max(1, total // BUCKET_BYTES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = "doc long, fp long, kind int, a long, b long, bucket int"
    one = long_.select("doc", "fp", "text__").mapInArrow(_pass1(buckets), BLOB).groupBy("bucket").applyInArrow(_reduce(False), schema)
    one = store(one, "pass1")
    contested = one.where("kind = 1").groupBy(*on).agg(F.collect_list(F.struct("bucket", F.col("a").alias("at"), F.col("b").alias("n"))).alias("spots"))
    # Both joins read the same columns of the documents, so that the texts are dealt out once.
    two = long_.join(contested, on).mapInArrow(_pass2, BLOB).groupBy("bucket").applyInArrow(_reduce(True), schema)
    spans = one.where("kind = 0").unionByName(two).groupBy(*on).agg(F.collect_list(F.struct("a", "b")).alias("marks__"))
    out = long_.join(spans, on, "left").unionByName(docs.where(~able), allowMissingColumns=True)
    out = out.select(*[F.col(f"{c}__in").alias(c) for c in keep], "text__", "marks__")
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name in keep), "kept binary", "n_bytes bigint", "n_removed bigint",
                        "spans array<struct<start:bigint,end:bigint>>", "kept_sha256 string"])
    return out.mapInArrow(lambda batches: _finish(batches, keep), fields)
