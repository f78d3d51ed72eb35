"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are runs of letters, digits and underscores, lower-cased. Of every four word n-grams in a row the rarer two are an
item's seeds (all, if it has eight or fewer). How rare an n-gram is depends on its rarest word, and that on the number of
documents with the word: a count that an edited copy of the item hardly changes, unlike the n-gram's own. Four in a row
are compared, not the whole item: where only a part of it is copied, that part's words are the less rare ones, and it
must have seeds all the same. A first scan counts the items' words, a second one looks for seeds. Where documents and seeds meet, the stretch of the document where the item
would lie is aligned with the item (match 2, mismatch -1, gap -1). A stretch is a hit if its score reaches ``min_score`` of
the item's perfect match, or if it has ``passage`` words or more and its score 0.8 of their own perfect match; so are
further ones beside it. Stretches with too few of the item's words for either, and for the second with fewer than three
seeds, are not aligned. The scan reads documents where they are; nothing is shuffled but counts.

Test items are broadcast in blocks of at most ``block_bytes`` of text (one block for usual benchmarks);
each block takes one scan.

Null texts: no words. Items of fewer than n words are not looked for. Repeated rows: each is judged; items with
equal texts: each has its hits. Empty tables: no hits. Very long texts and zones of many copies are aligned in
windows of four times an item's length. Columns of docs other than text and doc_id play no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import slices

HITS = "doc_id long, item_id long, score double, start_word long, end_word long"
_LOW = (1 << 32) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_words = re.compile(r"\w+").findall


def words_of(text: str | None) -> list[str]:
    return _words(text.lower()) if text else []


def align(item: np.ndarray, part: np.ndarray) -> tuple[int, int, int]:
    """(score, from, to) of the best local alignment of the item with a stretch of part.

    One row of scores is held, each with the place where its alignment began; memory grows with part alone."""
    steps = np.arange(len(part) + 1)
    row, start, best = np.zeros(len(part) + 1, dtype=np.int64), steps, (0, 0, 0)
    for x in item:
        fit, up = row[:-1] + np.where(part == x, 2, -1), row[1:] - 1
        score, began = np.r_[0, np.maximum(fit, up)], np.r_[0, np.where(fit >= up, start[:-1], start[1:])]
        score, began = np.maximum(score, 0), np.where(score > 0, began, steps)
        # A gap in the row costs 1 a word: the running maximum of score + place, which takes its beginning along.
        run = np.maximum.accumulate((score + steps) << 32 | (_LOW - began))
        row, start = (run >> 32) - steps, _LOW - (run & _LOW)
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), int(start[j]), j)
    return best


#: An item with so many n-grams has all as seeds; else the rarer half of each run of so many.
_LEAST, _RUN = 8, 4
#: Share of its own perfect match that a passage needs, and seeds in its zone.
_OWN, _SEEDS = 0.8, 3


class Items:
    """Test items as arrays of word ids; seeds as hashes (an equal hash of others only costs an alignment). counts: documents
    that have a word; words without a count are rarest."""

    def __init__(self, rows: list[tuple[int, str]], n: int, counts: dict[str, int] | None = None):
        self.n, words = n, [(i, words_of(t)) for i, t in rows]
        self.id: dict[str, int] = {}
        for _, ws in words:
            for w in ws:
                self.id.setdefault(w, len(self.id) + 1)
        kept = [(i, np.array([self.id[w] for w in ws], dtype=np.int64)) for i, ws in words if len(ws) >= n]
        self.name, self.item = [i for i, _ in kept], [a for _, a in kept]
        known = np.zeros(len(self.id) + 1, dtype=np.int64)
        for w, c in (counts or {}).items():
            known[self.id.get(w, 0)] = c
        places = [self.rare(known[a]) for a in self.item]
        grams = [self.grams(a)[p] for a, p in zip(self.item, places, strict=True)]
        self.gram = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        self.owner = np.repeat(np.arange(len(grams)), [len(g) for g in grams]) if grams else np.empty(0, dtype=np.int64)
        self.place = np.concatenate(places) if grams else np.empty(0, dtype=np.int64)

    def rare(self, count: np.ndarray) -> np.ndarray:
        """Places of an item's seeds: in each run of n-grams those whose rarest words are in the fewest documents; ties: by
        the next rarest words, then the first."""
        m = len(count) - self.n + 1
        if m <= _LEAST:
            return np.arange(m)
        each = np.sort(np.stack([count[k : k + m] for k in range(self.n)], axis=1), axis=1)
        order = np.lexsort((*each.T[::-1], np.arange(m) // _RUN))
        return np.sort(order[np.arange(m) % _RUN < _RUN // 2])

    @np.errstate(over="ignore")
    def grams(self, ids: np.ndarray) -> np.ndarray:
        m = max(0, len(ids) - self.n + 1)
        h = np.zeros(m, dtype=np.uint64)
        for k in range(self.n):
            h = h * _BASE + (ids[k : k + m].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(31))

    def found(self, texts: list[str | None], among: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(all word ids, first word of each text, place of each n-gram that is in ``among``, its index there)."""
        get = self.id.get
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ids = np.fromiter((get(w, 0) for ws in words for w in ws), dtype=np.int64, count=int(sizes.sum()))
        begins = np.cumsum(sizes) - sizes
        m = len(ids) - self.n + 1
        if m <= 0 or not len(among):
            return ids, begins, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        full = np.ones(m, dtype=bool)
        for k in range(self.n):
            full &= ids[k : k + m] > 0
        at = np.flatnonzero(full)
        at = at[at + self.n <= np.repeat(begins + sizes, sizes)[at]]
        h = np.zeros(0, dtype=np.uint64) if not len(at) else self.grams_at(ids, at)
        k = np.minimum(np.searchsorted(among, h), len(among) - 1)
        same = among[k] == h
        return ids, begins, at[same], k[same]

    @np.errstate(over="ignore")
    def grams_at(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.zeros(len(at), dtype=np.uint64)
        for k in range(self.n):
            h = h * _BASE + (ids[at + k].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(31))


class Finder:
    def __init__(self, items: Items, min_score: float, passage: int):
        self.items, self.min_score, self.passage = items, min_score, passage
        order = np.argsort(items.gram, kind="stable")
        self.gram, self.owner, self.place = items.gram[order], items.owner[order], items.place[order]
        self.among, self.first = np.unique(self.gram, return_index=True)
        self.stop = np.r_[self.first[1:], len(self.gram)] if len(self.first) else self.first

    def hits(self, texts: list[str | None]) -> list[tuple[int, int, float, int, int]]:
        """(index of the text, item, score, from word, to word)"""
        ids, begins, at, k = self.items.found(texts, self.among)
        if not len(at):
            return []
        ends = np.r_[begins[1:], len(ids)]
        doc = np.searchsorted(begins, at, side="right") - 1
        zones: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for p, d, g in zip(at.tolist(), doc.tolist(), k.tolist(), strict=True):
            for s in range(self.first[g], self.stop[g]):
                owner = int(self.owner[s])
                size = len(self.items.item[owner])
                slack, start = max(4, size // 3), p - int(self.place[s])
                zones.setdefault((d, owner), []).append((start - slack, start + size + slack))
        out = []
        for (d, owner), spans in zones.items():
            lo_doc, hi_doc, item = int(begins[d]), int(ends[d]), self.items.item[owner]
            merged: list[list[int]] = []
            for lo, hi in sorted(spans):
                if merged and lo <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], hi)
                    merged[-1][2] += 1
                else:
                    merged.append([lo, hi, 1])
            for lo, hi, seeds in merged:
                for score, a, b in self.stretches(item, ids, max(lo, lo_doc), min(hi, hi_doc), seeds >= _SEEDS):
                    out.append((d, self.items.name[owner], score / (2 * len(item)), a - lo_doc, b - lo_doc))
        return out

    def stretches(self, item: np.ndarray, ids: np.ndarray, lo: int, hi: int, passages: bool) -> list[tuple[int, int, int]]:
        """(score, from, to) of the best stretch of ids[lo:hi] and of those left and right of it; of parts of the item only
        with ``passages``.

        Zones of many copies go window by window; each stretch lies whole in one of them."""
        most = len(item) + max(4, len(item) // 3)
        step = 3 * most
        whole, part = self.min_score * 2 * len(item), _OWN * 2 * self.passage
        # A score of s takes s / 2 equal words.
        least = (min(whole, part) if passages else whole) / 2
        out, parts = [], [(at, min(at + step + most, hi)) for at in range(lo, max(lo + 1, hi - most), step)]
        while parts:
            lo, hi = parts.pop()
            if hi - lo < least or np.isin(item, ids[lo:hi]).sum() < least:
                continue
            score, a, b = align(item, ids[lo:hi])
            if score >= whole or passages and b - a >= self.passage and score >= _OWN * 2 * (b - a):
                out.append((score, lo + a, lo + b))
                parts += [(lo, lo + a), (lo + b, hi)]
        apart: list[tuple[int, int, int]] = []
        # What two windows have found comes once, from the window that holds it whole.
        for s in sorted(out, key=lambda s: (s[1], -s[0])):
            if apart and s[1] < apart[-1][2]:
                apart[-1] = max(apart[-1], s)
            else:
                apart.append(s)
        return apart


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The test items in blocks whose texts have at most ``block_bytes`` (a longer item: a block of its own), one at
    a time."""
    block, size = [], 0
    rows = benchmark.select(F.col(item_id).cast("long"), text).where(f"{text} is not null").orderBy(item_id, text)
    for i, t in rows.toLocalIterator():
        if block and size + len(t) > block_bytes:
            yield block
            block, size = [], 0
        block.append((i, t))
        size += len(t)
    yield block


def _counted(docs: DataFrame, text: str, words: set[str]) -> dict[str, int]:
    """Of these words (those of one block of items), the number of documents with each; counted in the tasks first."""
    wanted = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for b in batches:
            texts = b.column("text")
            for lo, hi in slices(b.column("_sl_size").to_pylist()):
                for t in texts.slice(lo, hi - lo).to_pylist():
                    count.update(wanted.value.intersection(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    # No more rows than words in a block.
    found = _sized(docs, text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in found}


def _finders(docs: DataFrame, benchmark: DataFrame, n: int, min_score: float, passage: int, text: str, item_id: str, item_text: str, block_bytes: int):
    """A broadcast finder for each block of items."""
    for rows in _blocks(benchmark, item_id, item_text, block_bytes):
        counts = _counted(docs, text, set().union(*[words_of(t) for _, t in rows])) if rows else {}
        yield docs.sparkSession.sparkContext.broadcast(Finder(Items(rows, n, counts), min_score, passage))


def _sized(docs: DataFrame, text: str, *columns: str) -> DataFrame:
    return docs.select(*columns, F.col(text).alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("_sl_size"))


def hits(docs: DataFrame, benchmark: DataFrame, n: int = 3, min_score: float = 0.6, passage: int = 13, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, item_id, score (1: word for word), start_word, end_word of every stretch that copies an item."""
    out = None
    for finder in _finders(docs, benchmark, n, min_score, passage, text, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            for b in batches:
                names, texts, found = b.column("doc_id").to_pylist(), b.column("text"), []
                for lo, hi in slices(b.column("_sl_size").to_pylist()):
                    found += [(names[lo + d], *rest) for d, *rest in finder.value.hits(texts.slice(lo, hi - lo).to_pylist())]
                columns = list(zip(*found, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in HITS.split(", ")])

        one = _sized(docs.withColumn("_sl_doc", F.col(doc_id).cast("long")), text, "_sl_doc").withColumnRenamed("_sl_doc", "doc_id").mapInArrow(run, HITS)
        out = one if out is None else out.unionByName(one)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 3, min_score: float = 0.6, passage: int = 13, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """docs without the rows that have a hit; all columns stay. The scan drops them as it reads."""
    out = docs
    for finder in _finders(docs, benchmark, n, min_score, passage, text, item_id, item_text, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], finder=finder) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, keep = b.column(text), np.ones(b.num_rows, dtype=bool)
                for lo, hi in slices([x or 0 for x in pc.binary_length(texts).to_pylist()]):
                    keep[[lo + d for d, *_ in finder.value.hits(texts.slice(lo, hi - lo).to_pylist())]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
