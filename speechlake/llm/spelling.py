"""Spelling variant grouping by dense prefix-suffix tiling.

Two words are one edit apart (an inserted, deleted or replaced code point) if their common prefix and common suffix
together reach the longer word's length less one. That test is made densely: words lie in padded code-point matrices,
one aligned at the left and one at the right, and blocks of rows are compared with blocks of rows.

Only blocks whose words may be so close are compared. Take the longer word of a pair, of m code points, and split the
places where the edit may be in two: either what is left of the right half agrees, or what is right of the left
half does. So each word, as the longer (m its length) and as the shorter one (m its length plus one), is filed under
both (m, head) and (m, tail), and a pair meets under one of the two. A key with more than ``crowd`` words is split again
within the places that are still open, round by round, down to a single place, where only words that differ just
there are left: so no block grows with the vocabulary, and no pair is lost.

``variants`` gives each word its form, the most frequent word one edit away if that is ``ratio`` times as frequent, and
its root, found by following forms (pointer jumping: the number of rounds is the logarithm of the longest chain).

Null text: no words. Null doc_id: counts as one without digits. Repeated rows: counted as often as they come. Empty
table: no rows. Very long texts and very long runs of letters: whole. Ties: the word first in code-point order. Other
columns play no part.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written
from .tokens import slices

_LETTERS = bytes(b if b >= 0xC0 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Words that a task counts before it passes them on.
_HELD = 200_000


def runs(text: str) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, one byte a code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def noted(run: bytes, begun: int, every: int) -> bytes:
    """The run, less one code point where ``every`` divides the crc32 that begins with ``begun``."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = 7, every: int = 31) -> DataFrame:
    """(word, n) over whole texts, words of ``min_length`` code points or more. Counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in held]), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for b in batches:
            ids, column = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in slices(b.column("size").to_pylist()):
                for d, t in zip(ids[lo:hi], column.slice(lo, hi - lo).to_pylist(), strict=True):
                    begun = zlib.crc32(b":" if d is None else b"%d:" % d)
                    for w, n in Counter(runs(t)).items():
                        w = noted(w, begun, every)
                        if len(w) >= min_length:
                            held[w] += n
                    if len(held) > _HELD:
                        yield passed()
        if held:
            yield passed()

    rows = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.octet_length(text).alias("size"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (word, n, m, i, j) with key: hash of m, of the first i and of the last j code points."""
    tail = F.when(F.col("j") > 0, F.substring("word", F.length("word") - F.col("j") + 1, F.col("j"))).otherwise("")
    return rows.withColumn("key", F.xxhash64("m", "i", "j", F.substring(F.col("word"), F.lit(1), F.col("i")), tail))


def _halved(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, i, j), each filed twice: the open places are all but the first i and the last j of m."""
    half = F.shiftright(F.col("m") - F.col("i") - F.col("j"), 1)
    ends = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    both = F.explode(F.array(ends(F.col("i") + half, F.col("j")), ends(F.col("i"), F.col("m") - F.col("i") - half)))
    return rows.select("word", "n", "m", both.alias("_sl_e")).select("word", "n", "m", "_sl_e.i", "_sl_e.j")


def _filed(words: DataFrame, crowd: int) -> DataFrame:
    """(key, m, word, n): no key with more than ``crowd`` words, unless they differ in one place only."""
    size = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(size, size + 1)).alias("m"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    rows, done = written(_keyed(_halved(whole))), None
    while True:
        many = rows.where("m - i - j > 1").groupBy(F.col("key").alias("_sl_k")).agg(F.count("*").alias("_sl_n")).where(F.col("_sl_n") > crowd)
        many = written(many.select("_sl_k"))
        rest = rows.join(many, F.col("key") == F.col("_sl_k"), "left_anti").select("key", "m", "word", "n")
        done = rest if done is None else done.unionByName(rest)
        if many.isEmpty():
            return done
        rows = written(_keyed(_halved(rows.join(many, F.col("key") == F.col("_sl_k"), "left_semi"))))


class Tile:
    """Words as two matrices of code points, aligned at the left and at the right; 0 is no code point of a word."""

    def __init__(self, words: list[str], width: int):
        self.size = np.array([len(w) for w in words])
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        row = np.repeat(np.arange(len(words)), self.size)
        at = np.arange(len(points)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        kind = np.uint8 if not len(points) or points.max() < 256 else np.uint32
        self.left, self.right = np.zeros((len(words), width), dtype=kind), np.zeros((len(words), width), dtype=kind)
        self.left[row, at] = points
        self.right[row, self.size[row] - 1 - at] = points

    def near(self, other: Tile) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of rows, one from each tile, that are one edit apart."""
        longer, shorter = np.maximum(self.size[:, None], other.size), np.minimum(self.size[:, None], other.size)
        reach = [np.minimum(_agree(a, b), shorter) for a, b in ((self.left, other.left), (self.right, other.right))]
        same = (longer == shorter) & (reach[0] == longer)
        return np.nonzero((reach[0] + reach[1] >= longer - 1) & (longer - shorter <= 1) & ~same)


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and each of b, how many columns agree before the first that does not."""
    differ = a[:, None, :] != b[None, :, :]
    first = differ.argmax(axis=2)
    return np.where(differ.any(axis=2), first, a.shape[1])


def tile_rows(width: int) -> int:
    """Rows of a tile: two tiles' comparison takes 2^18 places or so, and no less than one row each."""
    return int(np.clip(np.sqrt((1 << 18) / max(1, width)), 1, 128))


_PAIR = "a string, b string, na long, nb long"


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by m and key: each tile with itself and with the tiles after it that share its last key."""
    left: tuple[list, ...] = ([], [], [], [])

    def compared(m: list, key: list, word: list, n: list) -> Iterator[pa.RecordBatch]:
        lo = 0
        tiles = []
        while lo < len(key):
            rows = tile_rows(m[lo])
            hi = min(len(key), lo + rows)
            while m[hi - 1] > m[lo]:
                hi -= 1
            tiles.append((lo, hi))
            lo = hi
        out: list[tuple[np.ndarray, np.ndarray]] = []
        made: dict[int, Tile] = {}
        for x, (lo, hi) in enumerate(tiles):
            mine = made.pop(x, None) or Tile(word[lo:hi], m[lo])
            y = x
            while y < len(tiles) and (y == x or key[tiles[y][0]] == key[hi - 1]):
                if y > x and y not in made:
                    made[y] = Tile(word[tiles[y][0] : tiles[y][1]], m[lo])
                a, b = mine.near(made[y] if y > x else mine)
                out.append((a + lo, b + tiles[y][0]))
                y += 1
        a, b = (np.concatenate([o[k] for o in out]).tolist() if out else [] for k in (0, 1))
        ends = [(p, q) if word[p] < word[q] else (q, p) for p, q in zip(a, b, strict=True)]
        ends = list(dict.fromkeys((word[p], word[q], n[p], n[q]) for p, q in ends))
        for lo in range(0, len(ends), 1 << 16):
            some = ends[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in some], pa.string() if k < 2 else pa.int64()) for k in range(4)], names=["a", "b", "na", "nb"])

    for batch in batches:
        m, key, word, n = (x + batch.column(c).to_pylist() for x, c in zip(left, ("m", "key", "word", "n"), strict=True))
        # The last key may go on in the next batch; it has a bounded number of words.
        cut = len(key)
        while cut and key[cut - 1] == key[-1]:
            cut -= 1
        left = (m[cut:], key[cut:], word[cut:], n[cut:])
        yield from compared(m[:cut], key[:cut], word[:cut], n[:cut])
    yield from compared(*left)


def near_pairs(words: DataFrame, crowd: int = 256) -> DataFrame:
    """words (word, n), distinct -> (a, b, na, nb), a < b: all pairs one edit apart, each once."""
    filed = _filed(words, crowd).repartition("key").sortWithinPartitions("m", "key")
    return filed.select("m", "key", "word", "n").mapInArrow(_tiled, _PAIR).distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) without cycles -> (word, root): forms followed to the last one."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("_sl_w"), F.col("root").alias("_sl_r"))
        met = now.join(on, F.col("root") == F.col("_sl_w"), "left")
        step = written(met.select("word", F.coalesce("_sl_r", "root").alias("root"), F.col("_sl_r").isNotNull().alias("_sl_moved")))
        discard(now)
        now = step
        if now.where("_sl_moved").isEmpty():
            return now.select("word", "root")


def variants(words: DataFrame, ratio: int = 10, crowd: int = 256) -> DataFrame:
    """words (word, n), distinct -> word, form, root, n, n_near, form_n."""
    pairs = written(near_pairs(words, crowd))
    other = lambda a, b: pairs.select(F.col(a).alias("_sl_word"), F.col(b).alias("_sl_o"), F.col(f"n{a}").alias("_sl_own"), F.col(f"n{b}").alias("_sl_n"))
    best: Column = F.min(F.struct(-F.col("_sl_n"), F.col("_sl_o").alias("w")))
    found = other("a", "b").unionByName(other("b", "a")).groupBy("_sl_word").agg(F.count("*").alias("n_near"), F.max("_sl_n").alias("_sl_n"), best.alias("_sl_b"), F.max("_sl_own").alias("_sl_own"))
    taken = F.col("_sl_n") >= ratio * F.col("_sl_own")
    found = written(found.select("_sl_word", "n_near", F.when(taken, F.col("_sl_b.w")).alias("form"), F.when(taken, F.col("_sl_n")).alias("form_n")))
    root = roots(found.where("form is not null").select(F.col("_sl_word").alias("word"), "form")).withColumnRenamed("word", "_sl_v")
    out = words.join(found, F.col("word") == F.col("_sl_word"), "left").join(root, F.col("word") == F.col("_sl_v"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def group(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_length: int = 7, min_count: int = 2, every: int = 31, ratio: int = 10, crowd: int = 256) -> DataFrame:
    """The words of the texts with their variants."""
    words = written(counts(docs, text, doc_id, min_length, every).where(F.col("n") >= min_count))
    return variants(words, ratio, crowd)
