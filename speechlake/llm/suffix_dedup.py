"""Suffix-array dedup: bytes under a string of ``length`` bytes that also starts earlier are removed.

A string starts earlier if its document has a smaller doc_id, or earlier in the same document (row).
Sorting the suffix at every byte would move the corpus many times over, so the suffixes are thinned first, exactly:

* Every window (string of ``length`` bytes) is filed under its anchor, the least of its ``gram``-byte grams by hash
  (the leftmost of equal ones). Equal windows have equal anchors at equal offsets, so a window repeats only
  under an anchor that repeats. An anchor's windows follow each other: together they are its span.
* Anchors meet by hash, each distinct (anchor, span) of a batch once. Of equal spans all but the earliest go with
  all their windows. An anchor with one span only has no further repeats. What is left are spans that share an
  anchor and differ: the surroundings of where copies begin, end or were edited.
* Their suffixes are sorted. Spans are dealt by ranges of their leading bytes, the anchor's gram, with splitters that
  Spark samples, and each bucket sorts the suffixes of its windows by multikey quicksort over tokens of eight bytes:
  each round sorts the groups still tied by the next token and drops those that are alone. Equal runs have their
  earliest window found.
* Where one anchor has more than ``hot`` distinct spans, its suffixes are dealt one by one, by ranges of (their
  bytes, doc_id, row, place) between splitters from a sample, so that even equal ones spread over buckets; a run that
  goes on in the next bucket is compared across the boundary, by two rows a bucket.

Only the thinning relies on hashes (of over 100 bits); what is sorted is compared byte by byte. Batches are packed
once; each pass computes the same windows from them again, so that places and texts don't travel with hashes.

Null text: no bytes. Null doc_id: taken as larger than all others. Repeated rows: the same doc_id is not smaller, so
each row loses only what its own earlier part repeats, or smaller ids have. Empty table: no rows. Texts under ``length``
bytes: kept whole. Very long texts: a batch of their own. Columns other than doc_id and text play no part.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .substring_dedup import _LAST, _M1, _M2, _SENT, _joined, _mix, _pack, _rolled, _rows, _sent

#: What becomes of a distinct (anchor, span) of a batch.
_ALONE, _LATER, _SORT, _DEAL = range(4)


def sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    """Of every ``width`` consecutive values the least, by doubling."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


#: Windows whose hashes a task holds at a time. Where a block cuts a span its parts differ from equal spans elsewhere, and
#: their windows are sorted.
_BLOCK = 1 << 17


@np.errstate(over="ignore")
def _spans(body: np.ndarray, shift: int, begins: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first, last, anchor, row, m, s) of the spans in a block, which begins at ``shift`` of the joined text, whose
    documents begin and end at ``begins`` and ``ends``."""
    if len(body) < length:
        return tuple(np.empty(0, dtype=k) for k in (np.int64,) * 4 + (np.uint64,) * 2)
    byte = _mix(body.astype(np.uint64) + np.uint64(77))
    grams = _mix(_rolled(byte, gram, _M1))
    wide = length - gram + 1
    least = sliding_least(grams, wide)
    n = len(least)
    # Runs of windows of one document with one least value.
    new = np.r_[True, least[1:] != least[:-1]]
    for cut in (begins[ends > begins], np.maximum(begins, ends - length + 1)):
        cut = cut - shift
        new[cut[(cut >= 0) & (cut < n)]] = True
    first = np.flatnonzero(new)
    row = np.searchsorted(ends, first + shift, side="right")
    inside = first + shift + length <= ends[row]
    last = np.r_[first[1:], n] - 1
    first, last, row = first[inside], last[inside], row[inside]
    anchor = first + (grams[first[:, None] + np.arange(wide)] == least[first][:, None]).argmax(axis=1) if len(first) else first
    # A gram that comes twice (text with a short period): each of its places has its own windows.
    more = []
    for i in np.flatnonzero(last > anchor).tolist():
        a, b = int(first[i]), int(last[i])
        places = a + np.flatnonzero(grams[a : b + wide] == least[a])
        places = places[: int(np.searchsorted(places, b)) + 1]
        last[i] = min(b, int(places[0]))
        if len(places) > 1:
            more.append(np.stack([places[:-1] + 1, np.minimum(places[1:], b), places[1:], np.full(len(places) - 1, row[i])]))
    if more:
        first, last, anchor, row = (np.r_[x, y] for x, y in zip((first, last, anchor, row), np.concatenate(more, axis=1), strict=True))
        order = np.argsort(first, kind="stable")
        first, last, anchor, row = first[order], last[order], anchor[order], row[order]
    whole = _rolled(byte, length, _M2)
    # The first and the last window cover the span: it has at most ``wide`` windows.
    s = _mix(_mix(whole[first]) * _M1 + _mix(whole[last] ^ _M1) + (last - first).astype(np.uint64) * np.uint64(128) + (anchor - first).astype(np.uint64))
    # Mixed once more: a least hash is a small number, and a quarter of all spans would share the first of 256 buckets.
    return first + shift, last + shift, anchor + shift, row, _mix(grams[anchor]), s


class Spans:
    """The windows of one batch of documents, by anchor. Every step gives the same result whenever it runs.

    first, last: the windows of each span (places in the joined text); anchor: its anchor's place; doc, row: its document.
    """

    def __init__(self, doc_ids: list, sizes: list[int], body: bytes, length: int, gram: int):
        self.length, self.sizes = length, np.array(sizes, dtype=np.int64)
        self.docs = np.array([_LAST if d is None else d for d in doc_ids], dtype=np.int64)
        self.body = np.frombuffer(body, dtype=np.uint8)
        ends = np.cumsum(self.sizes)
        parts = [_spans(self.body[lo : lo + _BLOCK + length - 1], lo, ends - self.sizes, ends, length, gram) for lo in range(0, max(1, len(body) - length + 1), _BLOCK)]
        self.first, self.last, self.anchor, self.row, self.m, self.s = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.doc = self.docs[self.row]

    def kinds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct (m, s), sorted: m, s, least doc_id here; and each span's index in them."""
        order = np.lexsort((self.s, self.m))
        m, s = self.m[order], self.s[order]
        new = np.r_[True, (m[1:] != m[:-1]) | (s[1:] != s[:-1])] if len(m) else np.zeros(0, dtype=bool)
        index = np.empty(len(m), dtype=np.int64)
        index[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), _LAST)
        np.minimum.at(least, index, self.doc)
        return m[new], s[new], least, index

    def split(self, flag: np.ndarray, least: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether a span's windows all start earlier, too; the spans whose windows are to be sorted)."""
        gone = (flag[index] == _LATER) | (self.doc > least[index])
        # Spans are in order of place: of a document's equal ones the first stays.
        own = np.flatnonzero(~gone)
        key = index[own] * (len(self.sizes) + 1) + self.row[own]
        _, at = np.unique(key, return_index=True)
        first = np.zeros(len(own), dtype=bool)
        first[at] = True
        gone[own[~first]] = True
        return gone, own[first & (flag[index[own]] >= _SORT)]


def _opened(row: dict, length: int, gram: int) -> Spans:
    import zstandard

    body = zstandard.ZstdDecompressor().decompress(row["body"], max_output_size=max(1, row["n_bytes"]))
    return Spans(row["doc_ids"], row["sizes"], body, length, gram)


def _cuts(m: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of sorted hashes."""
    bucket, first = np.unique(m >> np.uint64(64 - bits), return_index=True)
    ends = [*first.tolist(), len(m)]
    return [(k, ends[i], ends[i + 1]) for i, k in enumerate(bucket.tolist())]


def _planes(x: np.ndarray, width: int) -> bytes:
    """The ``width`` low bytes, plane by plane, since the high bytes of ids are mostly equal."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(raw: bytes, n: int, width: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=n * at).reshape(width, n).T
    return out.view("<u8").ravel()


def _send(length: int, gram: int, bits: int):
    """Of each distinct (anchor, span): five bytes of the anchor's hash beside the bucket, eight of the span's, doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            m, s, least, _ = _opened(row, length, gram).kinds()
            rest = (m << np.uint64(bits)) >> np.uint64(24)
            out = [[row["_sl_batch"], k, hi - lo, _planes(rest[lo:hi], 5) + _planes(s[lo:hi], 8) + _planes(least[lo:hi].view(np.uint64), 8)] for k, lo, hi in _cuts(m, bits)]
            if out:
                yield _sent(out)

    return run


def _meet(hot: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, s, doc = (np.concatenate([_numbers(body, n, width, at) for n, body in zip(pdf["n"], pdf["body"], strict=True)]) for width, at in ((5, 0), (8, 5), (8, 13)))
        doc = doc.view(np.int64)
        order = np.lexsort((doc, s, m))
        m, s, doc = m[order], s[order], doc[order]
        anchor = np.r_[True, m[1:] != m[:-1]]
        span = anchor | np.r_[True, s[1:] != s[:-1]]
        group = np.cumsum(anchor) - 1
        spans = np.bincount(group, weights=span)[group]
        flag = np.where(spans > hot, _DEAL, np.where(spans > 1, _SORT, _ALONE)).astype(np.uint8)
        flag[doc > doc[span][np.cumsum(span) - 1]] = _LATER
        out = np.empty(len(flag), dtype=np.uint8)
        out[order] = flag
        ends = np.cumsum(pdf["n"].to_numpy()).tolist()
        return pd.DataFrame({"_sl_batch": pdf["_sl_batch"], "_sl_bucket": pdf["_sl_bucket"], "flags": [out[lo:hi].tobytes() for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]})

    return run


def _flags(row: dict, m: np.ndarray, bits: int) -> np.ndarray:
    got = {x["bucket"]: x["flags"] for x in row["marks"] or []}
    return np.concatenate([np.frombuffer(got[k], dtype=np.uint8) for k, _, _ in _cuts(m, bits)]) if len(m) else np.empty(0, dtype=np.uint8)


_SPANS = "_sl_batch long, doc long, row long, first long, n int, lead binary, body binary, hot boolean"


def _show(length: int, gram: int, bits: int):
    """The spans whose windows are to be sorted: their bytes, led by the anchor's gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _opened(row, length, gram)
            m, _, least, index = b.kinds()
            flag = _flags(row, m, bits)
            _, pick = b.split(flag, least, index)
            raw, n = b.body.tobytes(), len(pick)
            first, last, anchor = b.first[pick], b.last[pick], b.anchor[pick].tolist()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(n, row["_sl_batch"], dtype=np.int64)), pa.array(b.doc[pick]), pa.array(b.row[pick]), pa.array(first), pa.array((last - first + 1).astype(np.int32)),
                    pa.array([raw[a : a + gram] for a in anchor], pa.binary()), pa.array([raw[x:y] for x, y in zip(first.tolist(), (last + length).tolist(), strict=True)], pa.binary()), pa.array(flag[index[pick]] == _DEAL),
                ],
                names=[c.split()[0] for c in _SPANS.split(", ")],
            )

    return run


def equal_runs(text: bytes, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Multikey quicksort of the suffixes at ``at`` by their first ``length`` bytes, for those that are not alone:
    (their indices, in sorted order; the number of their run). Tokens are eight bytes; the last one may overlap."""
    data = np.frombuffer(text + bytes(8), dtype=np.uint8)
    token = np.ndarray(shape=(len(data) - 7,), dtype=">u8", buffer=data, strides=(1,))
    pick, run = np.arange(len(at)), np.zeros(len(at), dtype=np.int64)
    for depth in [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]:
        key = token[at[pick] + depth].astype(np.uint64)
        order = np.lexsort((key, run))
        pick, run, key = pick[order], run[order], key[order]
        new = np.r_[True, (run[1:] != run[:-1]) | (key[1:] != key[:-1])] if len(pick) else np.zeros(0, dtype=bool)
        run = np.cumsum(new) - 1
        many = np.bincount(run, minlength=1)[run] > 1
        pick, run = pick[many], run[many]
        if not len(pick):
            break
    return pick, np.cumsum(np.r_[True, run[1:] != run[:-1]]) - 1 if len(run) else run


def _order(pick: np.ndarray, run: np.ndarray, doc: np.ndarray, row: np.ndarray, place: np.ndarray):
    """Within runs by doc_id, row, place: (pick, run, whether a window starts earlier, too)."""
    order = np.lexsort((place[pick], row[pick], doc[pick], run))
    pick, run = pick[order], run[order]
    new = np.r_[True, run[1:] != run[:-1]] if len(run) else np.zeros(0, dtype=bool)
    same_row = ~new & np.r_[False, row[pick][1:] == row[pick][:-1]] if len(run) else new
    earlier = same_row | (doc[pick] > doc[pick][new][np.cumsum(new) - 1]) if len(run) else new
    return pick, run, earlier


def _table(batches: Iterator[pa.RecordBatch]) -> dict[str, pa.Array] | None:
    all_ = [b for b in batches if b.num_rows]
    if not all_:
        return None
    whole = pa.Table.from_batches(all_).combine_chunks()
    return {c: whole.column(c).chunk(0) for c in whole.column_names}


def _joined_rows(batch: np.ndarray, row: np.ndarray) -> np.ndarray:
    """One number for each (batch, row) here."""
    order = np.lexsort((row, batch))
    b, r = batch[order], row[order]
    out = np.empty(len(b), dtype=np.int64)
    out[order] = np.cumsum(np.r_[True, (b[1:] != b[:-1]) | (r[1:] != r[:-1])]) - 1
    return out


_GONE = "_sl_batch long, bytes binary"


def _by_batch(batch: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The batches, and the places of each as bytes."""
    order = np.argsort(batch, kind="stable")
    value, first = np.unique(batch[order], return_index=True)
    ends = [*first.tolist(), len(batch)]
    return value, [place[order[lo:hi]].astype("<i8").tobytes() for lo, hi in zip(ends, ends[1:], strict=False)]


def _sort(length: int):
    """A bucket of spans: the windows that start earlier, too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _table(batches)
        if t is None:
            return
        batch, doc, row, first, n = (t[c].to_numpy() for c in ("_sl_batch", "doc", "row", "first", "n"))
        row = _joined_rows(batch, row)
        bodies = t["body"].to_pylist()
        begins = np.cumsum([0, *map(len, bodies)])[:-1]
        span = np.repeat(np.arange(len(n)), n)
        step = np.arange(len(span)) - np.repeat(np.cumsum(n) - n, n)
        place = first[span] + step
        pick, equal = equal_runs(b"".join(bodies), begins[span] + step, length)
        pick, _, earlier = _order(pick, equal, doc[span], row[span], place)
        gone = pick[earlier]
        value, places = _by_batch(batch[span[gone]], place[gone])
        yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(places, pa.binary())], names=["_sl_batch", "bytes"])

    return run


_DEALT = "part int, n int, ids binary, text binary"
#: Windows looked at for each bucket to find where buckets begin.
_SAMPLED = 16


def splitters(spans: DataFrame, length: int, parts: int) -> list[tuple]:
    """Where the buckets of single windows begin: (bytes, doc, batch, row, place) of ``parts`` - 1 windows. One window of
    some spans is looked at, both chosen by hash: at most ``_SAMPLED`` for each bucket reach the driver."""
    if parts == 1:
        return []
    h = F.xxhash64("_sl_batch", "row", "first")
    step = F.pmod(F.xxhash64(h), F.col("n")).cast("int")
    one = spans.select(F.substring(F.col("body"), step + 1, F.lit(length)).alias("bytes"), "doc", "_sl_batch", "row", (F.col("first") + step).alias("place"), h.alias("_sl_h"))
    found = sorted(tuple(r)[:5] for r in one.orderBy("_sl_h", "_sl_batch", "row", "place").limit(_SAMPLED * parts).collect())
    found = [(bytes(r[0]), *r[1:]) for r in found]
    return sorted({found[len(found) * k // parts] for k in range(1, parts)})


def _deal(length: int, begins: list[tuple]):
    """The windows of spans one by one, by bucket: a row holds those of some spans in one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 2000):
                some = b.slice(lo, 2000)
                n, bodies = some.column("n").to_numpy(), some.column("body").to_pylist()
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                doc, batch, row, first = (np.repeat(some.column(c).to_numpy(), n) for c in ("doc", "_sl_batch", "row", "first"))
                ids = np.stack([doc, batch, row, first + step], axis=1)
                texts = [x[i : i + length] for x, k in zip(bodies, n.tolist(), strict=True) for i in range(k)]
                part = np.fromiter((bisect_right(begins, (x, *i)) for x, i in zip(texts, ids.tolist(), strict=True)), dtype=np.int64, count=len(texts))
                order = np.argsort(part, kind="stable")
                value, at = np.unique(part[order], return_index=True)
                ends = [*at.tolist(), len(part)]
                own = [order[x:y] for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.astype(np.int32)), pa.array([len(o) for o in own], pa.int32()), pa.array([ids[o].astype("<i8").tobytes() for o in own], pa.binary()), pa.array([b"".join([texts[i] for i in o.tolist()]) for o in own], pa.binary())],
                    names=["part", "n", "ids", "text"],
                )

    return run


#: kind 0: a batch's windows that start earlier, too (bytes: their places). 1: one that does so if its run began in a
#: bucket before. 2, 3: the bucket's first and last run.
_BUCKET = "part int, kind int, _sl_batch long, doc long, row long, place long, bytes binary, whole boolean"


def _sort_dealt(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        part, text = int(pdf["part"].iloc[0]), b"".join(pdf["text"])
        doc, batch, row, place = (x.copy() for x in np.frombuffer(b"".join(pdf["ids"]), dtype="<i8").reshape(-1, 4).T)
        own = _joined_rows(batch, row)
        n = len(doc)
        pick, equal = equal_runs(text, np.arange(n) * length, length)
        cut = [text[i : i + length] for i in range(0, n * length, length)]
        least, most = min(cut), max(cut)
        pick, _, earlier = _order(pick, equal, doc, own, place)
        rest = np.ones(n, dtype=bool)
        rest[pick[earlier]] = False
        # Of the first run, alone here or not, the rest may have begun in a bucket before.
        gone, open_ = pick[earlier], [i for i in np.flatnonzero(rest).tolist() if cut[i] == least]
        last = [i for i in range(n) if cut[i] == most]
        low, final = min(int(doc[i]) for i in last), max(last, key=lambda i: (doc[i], batch[i], row[i], place[i]))
        rows = [(part, 0, b, 0, 0, 0, places, False) for b, places in zip(*map(list, _by_batch(batch[gone], place[gone])), strict=True)]
        rows += [(part, 1, int(batch[i]), int(doc[i]), int(row[i]), int(place[i]), None, False) for i in open_]
        rows += [(part, k, int(batch[final]), low, int(row[final]), int(place[final]), x, least == most) for k, x in ((2, least), (3, most))]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _BUCKET.split(", ")])

    return run


def carried(edges: list[tuple[int, bytes, bytes, bool, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Edges of the buckets in order (part, first window, last window, whether that is one run, least doc_id of the last
    run, batch and row of its last window) -> (part, least doc_id, batch, row) where the first run began before."""
    out, before = [], None
    for part, first, last, whole, low, batch, row in edges:
        known = before if before and before[0] == first else None
        if known:
            out.append((part, *known[1:]))
        # Runs are in order of doc_id, so a run that goes on keeps the least doc_id of its beginning.
        before = (last, known[1] if known and whole else low, batch, row)
    return out


def _across(buckets: DataFrame) -> DataFrame:
    """(_sl_batch, bytes) of the dealt windows that start earlier, too."""
    spark = buckets.sparkSession
    # Two rows a bucket reach the driver, however many windows there are.
    ends: dict[int, dict] = {}
    for r in buckets.where("kind >= 2").collect():
        ends.setdefault(r["part"], {})[r["kind"]] = r
    edges = [(p, bytes(e[2]["bytes"]), bytes(e[3]["bytes"]), e[3]["whole"], e[3]["doc"], e[3]["_sl_batch"], e[3]["row"]) for p, e in sorted(ends.items())]
    before = spark.createDataFrame(carried(edges), "_sl_part int, _sl_low long, _sl_b long, _sl_r long")
    # As many rows as buckets at most.
    open_ = buckets.where("kind = 1").join(F.broadcast(before), F.col("part") == F.col("_sl_part"))
    later = (F.col("doc") > F.col("_sl_low")) | ((F.col("_sl_batch") == F.col("_sl_b")) & (F.col("row") == F.col("_sl_r")))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value, places = _by_batch(b.column("_sl_batch").to_numpy(), b.column("place").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(places, pa.binary())], names=["_sl_batch", "bytes"])

    return buckets.where("kind = 0").select("_sl_batch", "bytes").unionByName(open_.where(later).select("_sl_batch", "place").mapInArrow(packed, _GONE))


def _cut(length: int, gram: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            b = _opened(row, length, gram)
            m, _, least, index = b.kinds()
            gone, _ = b.split(_flags(row, m, bits), least, index)
            edge = np.zeros(len(b.body) + 1, dtype=np.int32)
            np.add.at(edge, b.first[gone], 1)
            np.add.at(edge, b.last[gone] + length, -1)
            for x in row["places"] or []:
                at = np.frombuffer(x, dtype="<i8")
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
            out = np.cumsum(edge[:-1]) > 0
            ends = np.cumsum(b.sizes)
            texts, removed, runs = [], [], []
            for lo, hi in zip((ends - b.sizes).tolist(), ends.tolist(), strict=True):
                mask = out[lo:hi]
                n = int(mask.sum())
                texts.append((b.body[lo:hi][~mask] if n else b.body[lo:hi]).tobytes())
                removed.append(n)
                runs.append(int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum()) if n else 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(b.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def dedup(docs: DataFrame, length: int = 100, gram: int = 40, text: str = "text", doc_id: str = "doc_id", hot: int = 256, per_bucket: int = 500_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (the bytes left)."""
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes or more and is no longer than a window")
    packs = written(_pack(docs, text, doc_id), codec="none")
    n_bytes = packs.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # An anchor every (length - gram) / 2 bytes or so. Buckets grow with the table, and there are at least four for each
    # shuffle partition, so that no task has much more than others.
    bits = int(np.clip(np.ceil(np.log2(max(1, 4 * partitions, 2 * n_bytes / (length - gram + 2) / per_bucket))), 6, 24))
    sent = packs.mapInArrow(_send(length, gram, bits), _SENT)
    marks = written(sent.groupBy("_sl_bucket").applyInPandas(_meet(hot), "_sl_batch long, _sl_bucket int, flags binary"))
    known = _joined(packs, marks, "marks")
    spans = written(known.mapInArrow(_show(length, gram, bits), _SPANS))
    windows = {r["hot"]: r["n"] for r in spans.groupBy("hot").agg(F.sum("n").alias("n")).collect()}
    # A bucket sorts about half a million windows.
    parts = lambda n: max(partitions, -(-n // 500_000))
    places = spans.where("not hot").repartitionByRange(parts(windows.get(False, 0)), "lead").mapInArrow(_sort(length), _GONE)
    if True in windows:
        begins = splitters(spans.where("hot"), length, 4 * parts(windows[True]))
        dealt = spans.where("hot").mapInArrow(_deal(length, begins), _DEALT)
        buckets = written(dealt.groupBy("part").applyInPandas(_sort_dealt(length), _BUCKET))
        places = places.unionByName(_across(buckets))
    places = written(places.groupBy("_sl_batch").agg(F.collect_list("bytes").alias("places")))
    return known.join(places, "_sl_batch", "left").mapInArrow(_cut(length, gram, bits), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
