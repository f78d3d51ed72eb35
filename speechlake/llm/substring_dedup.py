"""Substring dedup by level-wise doubling.

A window of ``window`` words that also starts in a document with a smaller doc_id is removed, with all the
words that it covers. Level 1 looks at windows of half the length; only windows repeated there are
extended to (about) twice that length and looked at on level 2, which is the length asked for.

* Level 1 need not look at every half window: each full window takes the half window of least hash in
  it (equal full windows take equal ones), so a full window that repeats has a repeated half window.
* Documents are packed once into compressed batches. A batch sends the sorted distinct hashes of its
  windows, split by leading bits, to the tasks that compare them, and gets one bit for each back. It then
  computes the same hashes again, so neither positions nor texts travel with them.
* Within a batch equal windows are merged first, so a window that a third of all documents share is
  sent once a batch.

Hashes of level 1 have 40 bits beside the bucket; a false match only costs work. Level 2 decides on 80
bits beside the bucket.

Null text: no words. Null doc_id: taken as larger than all others. Repeated rows: the same doc_id is not
smaller, so both keep their words. Empty table: no rows. Very long texts: a batch of their own, with all their
windows. Columns other than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import Recent, once, slices

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LAST = np.iinfo(np.int64).max


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _M2
    return x ^ (x >> np.uint64(29))


@np.errstate(over="ignore")
def _rolled(h: np.ndarray, length: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of every ``length`` consecutive values modulo 2**64, built by doubling."""
    out, have, power, step, wide = None, 0, np.uint64(1), h, 1
    power_of = {1: base}
    bits = length
    while bits:
        if bits & 1:
            if out is None:
                out, have, power = step, wide, power_of[wide]
            else:
                n = len(h) - (have + wide) + 1
                out = step[:n] * power + out[wide : wide + n]
                have, power = have + wide, power * power_of[wide]
        bits >>= 1
        if bits:
            n = max(0, len(h) - 2 * wide + 1)
            step = step[:n] * power_of[wide] + step[wide : wide + n]
            power_of[2 * wide] = power_of[wide] * power_of[wide]
            wide *= 2
    return out


class Batch:
    """The windows of one batch of documents. Every step gives the same result whenever it runs."""

    def __init__(self, doc_ids: list, texts: list[bytes], window: int, bits: int):
        from xxhash import xxh64_intdigest

        seen = once(("words", xxh64_intdigest), lambda: Recent(400_000))
        seen.turn()
        self.words, self.window, self.bits = [t.split() for t in texts], window, bits
        for w in seen.missing(set().union(*self.words)):
            seen[w] = xxh64_intdigest(w)
        self.sizes = np.array([len(ws) for ws in self.words], dtype=np.int64)
        self.hash = np.fromiter(map(seen.__getitem__, chain.from_iterable(self.words)), dtype=np.uint64, count=int(self.sizes.sum()))
        self.docs = np.array([_LAST if d is None else d for d in doc_ids], dtype=np.int64)
        n = max(0, len(self.hash) - window + 1)
        ends = np.repeat(np.cumsum(self.sizes), self.sizes)
        self.at = np.flatnonzero(np.arange(n) + window <= ends[:n]) if n else np.empty(0, dtype=np.int64)
        self.doc = np.repeat(self.docs, self.sizes)[self.at]

    def least(self) -> np.ndarray:
        """Of each full window the least hash of its half windows."""
        half = (self.window + 1) // 2
        h = _mix(_rolled(self.hash, half, _M1))
        n = len(self.hash) - self.window + 1
        out = h[:n].copy()
        for k in range(1, self.window - half + 1):
            np.minimum(out, h[k : k + n], out=out)
        return out[self.at]

    def halves(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct hashes, whether two documents here have it, each window's index in them)."""
        if not len(self.at):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=bool), np.empty(0, dtype=np.int64)
        value, index = np.unique(self.least(), return_inverse=True)
        low, high = np.full(len(value), _LAST), np.full(len(value), np.iinfo(np.int64).min)
        np.minimum.at(low, index, self.doc)
        np.maximum.at(high, index, self.doc)
        return value, low < high, index

    def full(self, repeated: np.ndarray, index: np.ndarray):
        """Of the windows whose half window is repeated: (hash, more hash bits, least doc_id here) of the
        distinct ones, sorted by hash; the windows, by distinct one; whether they lie in a later document."""
        pick = np.flatnonzero(repeated[index]) if len(index) else np.empty(0, dtype=np.int64)
        at, doc = self.at[pick], self.doc[pick]
        if not len(at):
            e = np.empty(0, dtype=np.uint64)
            return e, e.astype(np.uint16), e.astype(np.int64), at, at, at.astype(bool)
        a = _mix(_rolled(self.hash, self.window, _M1))[at]
        b = (_mix(_rolled(self.hash, self.window, _M2))[at] >> np.uint64(48)).astype(np.uint16)
        order = np.lexsort((doc, b, a))
        a, b, doc, at = a[order], b[order], doc[order], at[order]
        first = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        group = np.cumsum(first) - 1
        return a[first], b[first], doc[first], at, group, doc > doc[first][group]

    def buckets(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of sorted hashes."""
        bucket, first = np.unique(hashes >> np.uint64(64 - self.bits), return_index=True)
        ends = [*first.tolist(), len(hashes)]
        return [(k, ends[i], ends[i + 1]) for i, k in enumerate(bucket.tolist())]

    def flags(self, hashes: np.ndarray, got: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=bool)
        for k, lo, hi in self.buckets(hashes):
            out[lo:hi] = np.unpackbits(np.frombuffer(got[k], dtype=np.uint8), count=hi - lo).astype(bool)
        return out


def _pack(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """Batches of about 4 MB of text: _sl_batch, doc_ids, sizes, n_bytes, body (zstd)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for b in batches:
            sizes, ids, texts = b.column("size").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in slices(sizes):
                body = b"".join(texts.slice(lo, hi - lo).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[lo:hi]], pa.list_(pa.int64())), pa.array([sizes[lo:hi]], pa.list_(pa.int64())), pa.array([len(body)], pa.int64()), pa.array([packer.compress(body)], pa.binary())],
                    names=["doc_ids", "sizes", "n_bytes", "body"],
                )

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.encode(t, "utf-8").alias("text"), F.octet_length(t).cast("long").alias("size"))
    packed = rows.mapInArrow(run, "doc_ids array<long>, sizes array<long>, n_bytes long, body binary")
    return packed.withColumn("_sl_batch", F.monotonically_increasing_id())


def _opened(row: dict, window: int, bits: int) -> Batch:
    import zstandard

    body, ends = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"])), np.cumsum(row["sizes"]).tolist()
    return Batch(row["doc_ids"], [body[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)], window, bits)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _sent(row: list) -> pa.RecordBatch:
    kinds = (("_sl_batch", pa.int64()), ("_sl_bucket", pa.int32()), ("n", pa.int32()), ("body", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in row], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


_SENT = "_sl_batch long, _sl_bucket int, n int, body binary"


def _answer(pdf: pd.DataFrame, flags: np.ndarray) -> pd.DataFrame:
    ends = np.cumsum(pdf["n"].to_numpy()).tolist()
    bits = [np.packbits(flags[lo:hi]).tobytes() for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
    return pd.DataFrame({"_sl_batch": pdf["_sl_batch"], "_sl_bucket": pdf["_sl_bucket"], "flags": bits})


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Level 1: whether a hash comes from two batches, or from two documents of one."""
    parts, twice = [], []
    for n, body in zip(pdf["n"], pdf["body"], strict=True):
        raw = np.zeros((n, 8), dtype=np.uint8)
        raw[:, :5] = np.frombuffer(body, dtype=np.uint8, count=5 * n).reshape(n, 5)
        parts.append(raw.view("<u8").ravel())
        twice.append(np.unpackbits(np.frombuffer(body, dtype=np.uint8, offset=5 * n), count=n).astype(bool))
    value, twice = np.concatenate(parts), np.concatenate(twice)
    _, index, count = np.unique(value, return_inverse=True, return_counts=True)
    many = count > 1
    many[index[twice]] = True
    return _answer(pdf, many[index])


def _later(pdf: pd.DataFrame) -> pd.DataFrame:
    """Level 2: whether a window's least document in its batch is not its least document of all."""
    kind = np.dtype([("a", "<u8"), ("b", "<u2"), ("doc", "<i8")])
    rows = np.concatenate([np.frombuffer(body, dtype=kind) for body in pdf["body"]])
    order = np.lexsort((rows["doc"], rows["b"], rows["a"]))
    s = rows[order]
    first = np.r_[True, (s["a"][1:] != s["a"][:-1]) | (s["b"][1:] != s["b"][:-1])]
    later = np.empty(len(rows), dtype=bool)
    later[order] = s["doc"] > s["doc"][first][np.cumsum(first) - 1]
    return _answer(pdf, later)


def _level1(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _opened(row, window, bits)
            value, twice, _ = b.halves()
            rest = ((value << np.uint64(bits)) >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
            out = [[row["_sl_batch"], k, hi - lo, rest[lo:hi].tobytes() + np.packbits(twice[lo:hi]).tobytes()] for k, lo, hi in b.buckets(value)]
            if out:
                yield _sent(out)

    return run


def _marks(row: dict, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["flags"] for x in row[name] or []}


def _level2(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _opened(row, window, bits)
            value, _, index = b.halves()
            a, more, doc, *_ = b.full(b.flags(value, _marks(row, "marks1")), index)
            packed = np.empty(len(a), dtype=[("a", "<u8"), ("b", "<u2"), ("doc", "<i8")])
            packed["a"], packed["b"], packed["doc"] = a, more, doc
            out = [[row["_sl_batch"], k, hi - lo, packed[lo:hi].tobytes()] for k, lo, hi in b.buckets(a)]
            if out:
                yield _sent(out)

    return run


def _cut(window: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _opened(row, window, bits)
            value, _, index = b.halves()
            a, _, _, at, group, local = b.full(b.flags(value, _marks(row, "marks1")), index)
            later = b.flags(a, _marks(row, "marks2"))
            gone = at[local | later[group]] if len(at) else at
            edge = np.zeros(len(b.hash) + 1, dtype=np.int64)
            np.add.at(edge, gone, 1)
            np.add.at(edge, gone + window, -1)
            kept = np.cumsum(edge[:-1]) == 0
            ends = np.cumsum(b.sizes)
            texts, removed = [], []
            for words, lo, hi in zip(b.words, ends - b.sizes, ends, strict=True):
                mask = kept[lo:hi]
                n = int(mask.sum())
                texts.append(b" ".join(words if n == len(words) else [words[i] for i in np.flatnonzero(mask)]))
                removed.append(len(words) - n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(b.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def _joined(packs: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """packs with the answers to each batch (at most one for each bucket)."""
    marks = answers.groupBy("_sl_batch").agg(F.collect_list(F.struct(F.col("_sl_bucket").alias("bucket"), "flags")).alias(name))
    return packs.join(marks, "_sl_batch", "left")


def dedup(docs: DataFrame, window: int = 13, text: str = "text", doc_id: str = "doc_id", per_bucket: int = 500_000) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the kept words, joined by one space, as UTF-8 bytes)."""
    packs = written(_pack(docs, text, doc_id), codec="none")
    n_bytes = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    # A window every 6 bytes or so, a quarter of them least ones. Buckets grow with the table (2^24 of them hold 200 TB
    # of text); there are at least four for each shuffle partition, so that no task has much more than others.
    least = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = int(np.clip(np.ceil(np.log2(max(1, least, n_bytes / 24 / per_bucket))), 6, 24))
    sent = packs.mapInArrow(_level1(window, bits), _SENT)
    marks1 = written(sent.groupBy("_sl_bucket").applyInPandas(_repeated, "_sl_batch long, _sl_bucket int, flags binary"))
    once_more = _joined(packs, marks1, "marks1")
    sent = once_more.mapInArrow(_level2(window, bits), _SENT)
    marks2 = written(sent.groupBy("_sl_bucket").applyInPandas(_later, "_sl_batch long, _sl_bucket int, flags binary"))
    return _joined(once_more, marks2, "marks2").mapInArrow(_cut(window, bits), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary")
