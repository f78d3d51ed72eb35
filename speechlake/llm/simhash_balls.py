"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most 2r bits share a variant: one at most r flips away from both.
So every distinct fingerprint emits all its variants within r = 2 flips, equal variants meet, and those
who meet are at most 2r apart by the triangle inequality (the distance is checked all the same).

Only distinct fingerprints take part, so a group of copies counts once. The shuffle is on the variants'
first ``prefix`` bits: a fingerprint is sent once to each prefix that its variants have (1 + p + p(p-1)/2
of them), and the task that gets it writes out the variants' other bits there: all variants meet,
but 2081 variants cost a few dozen messages on the wire. Where m fingerprints share a variant, the
smallest one is linked to the others: m - 1 links, which connect as much as all pairs would.

``classes`` and ``dedup`` take links as they are. ``near_copies`` is for texts whose word 5-shingles are to be similar
by 0.8: fingerprints of shingles lie too far apart there, so it takes those of words and word pairs, in which such
texts are close, by three seeds (a pair that is close by any of them meets). Texts that share no band of their MinHash sketches with any other take no part in it (a similar
pair shares none with odds of 1 in 10^7). Colliding pairs whose shingle counts or MinHash
sketches rule out that similarity end there (a similar pair does with odds of 1 in 10^5); the others are verified on
the shingles themselves.

Null and wordless texts: fingerprint zero, linked like any other (near copies: equal to each other, like no other).
Repeated rows: all in one component. Null doc_id: has a component, but does not name it. Empty table: no rows. Very
long texts: whole, their counts summed in blocks. Other columns stay; those of ``dedup`` may have any names but _sl_.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import components, discard, written
from .tokens import Recent, slices

BITS = 64
_SUM_ROWS = 1 << 16
#: Variants that are held at once, and fingerprints whose messages are.
_VARIANTS, _SENT = 500_000, 4_000


def fingerprint(text: bytes, shingle: int | tuple[int, ...] = 4, seed: int = 42) -> int:
    """Bit b is set if over half the XXH64 values of the word shingles (of one length or several) have it; A-Z are
    lower-cased."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    counts, n = np.zeros(BITS, dtype=np.int64), 0
    for length in (shingle,) if isinstance(shingle, int) else shingle:
        length = min(length, len(words))
        begins, stops = [0, *(ends[: len(words) - length] + 1).tolist()], ends[length - 1 :].tolist()
        n += len(begins)
        for lo in range(0, len(begins), _SUM_ROWS):
            h = np.fromiter([xxh64_intdigest(line[a:b], seed) for a, b in zip(begins[lo : lo + _SUM_ROWS], stops[lo : lo + _SUM_ROWS], strict=True)], dtype="<u8")
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = (), shingle: int | tuple[int, ...] = 4) -> DataFrame:
    """doc_id, the columns in keep, fp (the 64 bits as a long). No shuffle."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), *keep, F.encode(F.coalesce(F.col(text), F.lit("")), "utf-8").alias("_sl_text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("_sl_size"))
    own = ["doc_id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column, out = b.column("_sl_text"), []
            for lo, hi in slices(b.column("_sl_size").to_pylist()):
                out += [fingerprint(t, shingle) for t in column.slice(lo, hi - lo).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=[*own, "fp"])

    return rows.mapInArrow(run, rows.select(*own, F.lit(0).cast("long").alias("fp")).schema)


def _flips(bits: range, most: int) -> list[np.uint64]:
    return [np.uint64(sum(1 << b for b in at)) for k in range(most + 1) for at in combinations(bits, k)]


def links(fps: DataFrame, n_fps: int, radius: int = 4, held: int = _VARIANTS) -> DataFrame:
    """fps (fp long, distinct) -> (a, b): for every variant that several fingerprints share, its smallest
    one with each other one. Equal links from one task come once; about ``held`` variants are in its memory at once. ``radius`` is even: half of it goes to each side."""
    if radius % 2:
        raise ValueError(f"the radius is twice that of a ball, so it is even, not {radius}")
    half = radius // 2
    # About 400 000 variants a prefix, so a task's memory does not grow with the input.
    prefix = int(np.clip(np.ceil(np.log2(max(1, n_fps * 2081 / 400_000))), 4, 24))
    shift, low = BITS - prefix, range(0, BITS - prefix)
    ball = {k: np.array(_flips(low, half - k), dtype=np.uint64) for k in range(half + 1)}
    masks = [(k, np.uint64(sum(1 << b for b in at))) for k in range(half + 1) for at in combinations(range(prefix), k)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.asarray(b.column("fp")).view(np.uint64)
            for lo in range(0, len(fp), _SENT):
                part = fp[lo : lo + _SENT]
                top = part >> np.uint64(shift)
                to = np.concatenate([top ^ m for _, m in masks]).astype(np.int64)
                left = np.repeat(np.array([half - k for k, _ in masks], dtype=np.int8), len(part))
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(left), pa.array(np.tile(part, len(masks)).view(np.int64))], names=["_sl_prefix", "_sl_left", "fp"])

    def some(fp: np.ndarray, left: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        """Links of fingerprints (flips left of each) that share a variant; the variants' other bits are the lowest ones."""
        mine = [np.unique(fp[left == half - k]) for k in range(half + 1)]
        if bits > 1 and sum(len(m) * comb(bits, i) for k, m in enumerate(mine) for i in range(half - k + 1)) > held:
            # Fingerprints that begin alike can be many: one bit more, which those with a flip left may have either way.
            top = (fp >> np.uint64(bits - 1)) & np.uint64(1)
            for b in (0, 1):
                same, other = top == b, (top != b) & (left > 0)
                yield from some(np.concatenate([fp[same], fp[other]]), np.concatenate([left[same], left[other] - 1]), bits - 1)
            return
        tail = np.uint64((1 << bits) - 1)
        variants, owners = [], []
        for k in range(half + 1):
            flips = np.array(_flips(range(bits), half - k), dtype=np.uint64) if bits < shift else ball[k]
            variants.append(((mine[k] & tail)[:, None] ^ flips[None, :]).ravel())
            owners.append(np.repeat(mine[k], len(flips)))
        v, o = np.concatenate(variants), np.concatenate(owners)
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        first = np.r_[True, v[1:] != v[:-1]] if len(v) else np.zeros(0, dtype=bool)
        group = np.cumsum(first) - 1
        size = np.bincount(group, minlength=1)
        many = size[group] > 1
        o, group = o[many], group[many]
        if not len(o):
            return
        at = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        least = np.minimum.reduceat(o, at)[np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1]
        pair = np.unique(np.stack([least, o], axis=1)[least != o], axis=0)
        yield pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= radius]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        found = list(some(pdf["fp"].to_numpy().view(np.uint64), pdf["_sl_left"].to_numpy(), shift))
        pair = np.unique(np.concatenate([np.empty((0, 2), dtype=np.uint64), *found]), axis=0)
        return pd.DataFrame({"a": np.ascontiguousarray(pair[:, 0]).view(np.int64), "b": np.ascontiguousarray(pair[:, 1]).view(np.int64)})

    sent = fps.select("fp").mapInArrow(send, "_sl_prefix long, _sl_left byte, fp long")
    return sent.groupBy("_sl_prefix").applyInPandas(meet, "a long, b long").distinct()


def classes(docs: DataFrame, radius: int = 4, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns in keep, fp, root (of the component), component_id (smallest doc_id reachable)."""
    rows = written(fingerprints(docs, text, doc_id, keep))
    distinct = written(rows.groupBy("fp").agg(F.min("doc_id").alias("_sl_first")))
    roots = components(links(distinct, distinct.count(), radius))
    joined = distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "_sl_first", F.coalesce("root", "fp").alias("_sl_root"))
    named = written(joined).groupBy("_sl_root").agg(F.min("_sl_first").alias("component_id"))
    of = written(joined.join(named, "_sl_root").select(F.col("fp").alias("_sl_fp"), F.col("_sl_root").alias("root"), "component_id"))
    return rows.join(of, F.col("fp") == F.col("_sl_fp")).select("doc_id", *keep, "fp", "root", "component_id")


def dedup(docs: DataFrame, radius: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component: the one with the smallest doc_id (of repeated rows, any one)."""
    rows = written(docs.withColumn("_sl_row", F.monotonically_increasing_id()))
    found = written(classes(rows, radius, text, doc_id, keep=("_sl_row",)))
    stays = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_sl_row")).alias("_sl_w")).select(F.col("_sl_w._sl_row").alias("_sl_row"))
    return rows.join(written(stays), "_sl_row", "left_semi").select(*docs.columns)


#: MinHash values of a sketch, and how many of them a similar pair must share (26 are expected at 0.8).
_SKETCH, _SHARED = 32, 14
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], dtype=np.uint64)
_TURNS = (np.arange(1, 2 * _SKETCH, 2, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


@np.errstate(over="ignore")
def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


@np.errstate(over="ignore")
def near_features(h: np.ndarray, length: int) -> tuple[list[int], int, bytes]:
    """Of word hashes in order: fingerprints of words and pairs by each seed, number of distinct shingles, sketch."""
    if not len(h):
        return [0] * len(_SEEDS), 0, bytes(2 * _SKETCH)
    units = np.concatenate([h, _mix(h[:-1] * _SEEDS[0] + h[1:])])
    prints = []
    for seed in _SEEDS:
        counts = np.zeros(BITS, dtype=np.int64)
        for lo in range(0, len(units), _SUM_ROWS):
            counts += np.unpackbits(_mix(units[lo : lo + _SUM_ROWS] ^ seed).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
        prints.append(int.from_bytes(np.packbits(counts * 2 > len(units), bitorder="little").tobytes(), "little"))
    n, s = max(1, len(h) - length + 1), np.zeros(max(1, len(h) - length + 1), dtype=np.uint64)
    for k in range(min(length, len(h))):
        s = s * _SEEDS[1] + h[k : k + n]
    s = np.unique(_mix(s))
    least = np.full(_SKETCH, np.iinfo(np.uint64).max)
    for lo in range(0, len(s), 4096):
        np.minimum(least, (_mix(s[lo : lo + 4096, None] * _TURNS)).min(axis=0), out=least)
    return prints, len(s), (least & np.uint64(0xFFFF)).astype("<u2").tobytes()


_NEAR = "_sl_row long, doc_id long, _sl_md5 string, " + "".join(f"fp{i} long, " for i in range(len(_SEEDS))) + "n long, sketch binary"


def _near_rows(rows: DataFrame, text: str, doc_id: str, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        # Not kept for the worker's next tasks: executors run short of memory in joins that come later.
        seen = Recent(400_000)
        for b in batches:
            column, out = b.column("_sl_text"), []
            for lo, hi in slices(b.column("_sl_size").to_pylist()):
                texts = [t.lower().split() for t in column.slice(lo, hi - lo).to_pylist()]
                seen.turn()
                for w in seen.missing(set().union(*texts)):
                    seen[w] = xxh64_intdigest(w)
                out += [near_features(np.fromiter(map(seen.__getitem__, ws), dtype=np.uint64, count=len(ws)), length) for ws in texts]
            fps = np.array([f for f, _, _ in out], dtype=np.uint64).reshape(-1, len(_SEEDS)).view(np.int64)
            columns = [b.column(c) for c in ("_sl_row", "doc_id", "_sl_md5")] + [pa.array(np.ascontiguousarray(fps[:, i])) for i in range(len(_SEEDS))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([n for _, n, _ in out], pa.int64()), pa.array([x for _, _, x in out], pa.binary())], names=[c.split()[0] for c in _NEAR.split(", ")])

    t = F.coalesce(F.col(text), F.lit(""))
    return rows.select("_sl_row", F.col(doc_id).cast("long").alias("doc_id"), "_sl_md5", F.encode(t, "utf-8").alias("_sl_text"), F.octet_length(t).alias("_sl_size")).mapInArrow(run, _NEAR)


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes (nid, n, sketch) that shingle counts and sketches don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype="<u2").reshape(-1, _SKETCH) for c in ("_sl_x", "_sl_y"))
            yield b.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= _SHARED))

    x, y = (nodes.select(F.col("nid").alias(k), F.col("n").alias(f"_sl_n{k}"), F.col("sketch").alias(s)) for k, s in (("a", "_sl_x"), ("b", "_sl_y")))
    near = F.least("_sl_na", "_sl_nb") >= similarity * F.greatest("_sl_na", "_sl_nb")
    return pairs.join(x, "a").join(y, "b").where(near).select("a", "b", "_sl_x", "_sl_y").mapInArrow(run, "a long, b long")


def _shingles(text: bytes, length: int) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + length]) for i in range(max(1, len(words) - length + 1))} if words else set()


def _verified(pairs: DataFrame, texts: DataFrame, length: int, similarity: float) -> DataFrame:
    """Pairs (a, b) of texts (nid, text) whose word shingles have at least that Jaccard similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, last, own = [], None, set()
            for x, y in zip(batch.column("_sl_x"), batch.column("_sl_y"), strict=True):
                x, y = x.as_py(), y.as_py()
                if x != last:
                    last, own = x, _shingles(x, length)
                other = _shingles(y, length)
                both = len(own & other)
                keep.append(both >= similarity * (len(own) + len(other) - both) and both > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x, y = texts.select(F.col("nid").alias("a"), F.col("text").alias("_sl_x")), texts.select(F.col("nid").alias("b"), F.col("text").alias("_sl_y"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "_sl_x", "_sl_y").mapInArrow(run, "a long, b long")


#: MinHash values of a band: a similar pair shares none of the 16 bands with odds of 1 in 10^7 at 0.8.
_BAND = 2


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal or similar texts: the one with the smallest doc_id (of repeated rows,
    any one). Equal texts are one node; pairs of nodes come from ball hashing and are all verified.

    Only texts that share a sketch band with another have balls. A block is what one fingerprint collides with. First each node of a block meets the block's least; where a block
    still has several groups, its nodes meet by sketch bands: in a band the least nodes of some groups meet those of all
    others, with twice as many in each round, until all have met."""
    rows = written(docs.withColumn("_sl_row", F.monotonically_increasing_id()).withColumn("_sl_md5", F.md5(F.coalesce(text, F.lit("")))))
    found = written(_near_rows(rows, text, doc_id, words))
    prints = [f"fp{i}" for i in range(len(_SEEDS))]
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_sl_row")).alias("_sl_least")
    nodes = found.groupBy("_sl_md5").agg(*[F.first(c).alias(c) for c in (*prints, "n", "sketch")], least)
    nodes = written(nodes.withColumn("nid", F.monotonically_increasing_id()))
    # Texts of few common words have fingerprints that are close by chance, the more the more texts there are: those whose
    # bands no other text has end before the balls.
    bands = written(_shared_bands(nodes.where("n > 0")))
    some = written(nodes.join(bands, F.col("nid") == F.col("_sl_nid"), "left_semi").select("nid", *prints))
    blocks = written(reduce(DataFrame.unionByName, [_blocks(some.select("nid", F.col(fp).alias("fp")), radius, i) for i, fp in enumerate(prints)]))

    def similar(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that are similar. Texts are read for those that counts and sketches don't rule out."""
        likely = written(_likely(pairs, nodes, similarity))
        ids = likely.select(F.explode(F.array("a", "b")).alias("nid")).distinct()
        named = ids.join(nodes.select("nid", F.col("_sl_least._sl_row").alias("_sl_row")), "nid")
        texts = rows.select("_sl_row", F.encode(F.coalesce(text, F.lit("")), "utf-8").alias("text")).join(named, "_sl_row").select("nid", "text")
        return written(_verified(likely, texts, words, similarity))

    first = blocks.groupBy(F.col("block").alias("_sl_k")).agg(F.min("nid").alias("a"))
    tried = written(blocks.join(first, F.col("block") == F.col("_sl_k")).where("a <> nid").select("a", F.col("nid").alias("b")).distinct())
    links = similar(tried)
    roots, most, banded = written(components(links)), 1, None
    while True:
        known = roots.select(F.col("node").alias("_sl_node"), "root")
        rooted = lambda df, known=known: df.join(known, F.col("nid") == F.col("_sl_node"), "left").withColumn("root", F.coalesce("root", "nid")).drop("_sl_node")
        if banded is None:
            several = rooted(blocks).groupBy(F.col("block").alias("_sl_k")).agg(F.min("root").alias("_sl_lo"), F.max("root").alias("_sl_hi")).where("_sl_lo < _sl_hi").select("_sl_k")
            banded = written(_banded(blocks.join(several, F.col("block") == F.col("_sl_k"), "left_semi"), nodes, bands))
        ends = written(rooted(banded).groupBy("band", "root").agg(F.min("nid").alias("nid")))
        groups = ends.groupBy("band").agg(F.count("*").alias("_sl_n")).agg(F.max("_sl_n")).first()[0] or 0
        if groups < 2:
            break
        # Only so many rows of a band leave each task.
        some = F.row_number().over(W.partitionBy("_sl_k").orderBy(F.xxhash64("_sl_to"), "_sl_to"))
        to = ends.select(F.col("band").alias("_sl_k"), F.col("nid").alias("_sl_to"), F.col("root").alias("_sl_r")).withColumn("_sl_i", some).where(F.col("_sl_i") <= most)
        pairs = ends.join(to, (F.col("band") == F.col("_sl_k")) & (F.col("root") != F.col("_sl_r"))).select(F.least("nid", "_sl_to").alias("a"), F.greatest("nid", "_sl_to").alias("b")).distinct()
        pairs = written(pairs.join(tried, ["a", "b"], "left_anti"))
        new = similar(pairs)
        tried = tried.unionByName(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)
            roots = written(components(links))
        elif most >= groups:
            break
        most *= 2
    of_root = nodes.join(roots, F.col("nid") == F.col("node"), "left").groupBy(F.coalesce("root", "nid")).agg(F.min("_sl_least").alias("_sl_w"))
    return rows.join(written(of_root.select(F.col("_sl_w._sl_row").alias("_sl_row"))), "_sl_row", "left_semi").select(*docs.columns)


def _shared_bands(nodes: DataFrame) -> DataFrame:
    """nodes (nid, sketch) -> (_sl_nid, _sl_bands): the bands of a node that another node has too, if any.

    Most bands are a single node's, so they end first, by node: else each would be shuffled once for every block that
    its node is in."""
    part = lambda k: F.xxhash64(k, F.substring(F.col("sketch"), 2 * _BAND * k + 1, F.lit(2 * _BAND)))
    bands = F.transform(F.sequence(F.lit(0), F.lit(_SKETCH // _BAND - 1)), part)
    own = written(nodes.select("nid", F.explode(bands).alias("_sl_b")))
    some = own.groupBy(F.col("_sl_b").alias("_sl_k")).agg(F.count("*").alias("_sl_n")).where("_sl_n > 1").select("_sl_k")
    kept = written(own.join(some, F.col("_sl_b") == F.col("_sl_k"), "left_semi"))
    discard(own)
    return kept.groupBy(F.col("nid").alias("_sl_nid")).agg(F.collect_set("_sl_b").alias("_sl_bands"))


def _banded(blocks: DataFrame, nodes: DataFrame, bands: DataFrame | None = None) -> DataFrame:
    """blocks (block, nid; distinct), nodes (nid, sketch) -> (nid, band): the bands that several nodes of a block share.
    bands: ``_shared_bands`` of the nodes, where they are known already."""
    if bands is None:
        bands = written(_shared_bands(nodes.join(blocks.select("nid").distinct(), "nid", "left_semi")))
    met = blocks.join(bands, F.col("nid") == F.col("_sl_nid"))
    banded = written(met.select("nid", "block", F.explode("_sl_bands").alias("_sl_b")).select("nid", F.xxhash64("block", "_sl_b").alias("band")))
    shared = banded.groupBy(F.col("band").alias("_sl_k")).agg(F.count("*").alias("_sl_n")).where("_sl_n > 1").select("_sl_k")
    return banded.join(shared, F.col("band") == F.col("_sl_k"), "left_semi")


def _blocks(nodes: DataFrame, radius: int, seed: int) -> DataFrame:
    """nodes (nid, fp) -> (block, nid): two texts whose fingerprints share a variant, or are equal, share a block, that of
    the variant's least fingerprint."""
    fps = written(nodes.groupBy("fp").agg(F.count("*").alias("_sl_n")))
    met = written(links(fps.select("fp"), fps.count(), radius))
    own = met.select(F.col("a").alias("_sl_c"), F.col("b").alias("_sl_fp")).unionByName(met.select(F.col("a").alias("_sl_c"), F.col("a").alias("_sl_fp")))
    own = own.unionByName(fps.where("_sl_n > 1").select(F.col("fp").alias("_sl_c"), F.col("fp").alias("_sl_fp"))).distinct()
    return nodes.join(own, F.col("fp") == F.col("_sl_fp")).select(F.xxhash64(F.lit(seed), "_sl_c").alias("block"), "nid")
