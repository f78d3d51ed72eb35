"""Conversation prefix trie over a minimal-perfect-hash node table.

A node is a distinct sequence of a conversation's first d turns (role, text). Turns are numbered by range partitions, and
of a turn only hashes and its length go on. A prefix has a digest of four sums, of 32-bit pieces of hashes of (place,
turn): sums can be taken piece by piece, so a conversation of any length is many tasks. ``band`` turns of a conversation
make a piece; pieces are dealt to shards by hash, each shard holding pieces of one band.

A shard enumerates its distinct prefix digests, gives each a slot by a minimal perfect hash, and checks the digest kept
in a slot against the digest asked for. Counts are scattered into flat arrays by slot. Since copies of a prefix may be in
many shards, shards' counts are then added up by digest; each node is owned by the shard of its smallest conversation,
which adds its own weight, and shards add up subtrees through their arrays of parent slots, deepest nodes first; what
shards have under a common prefix is added up by digest once more. So a prefix that all conversations share is a
few rows from each shard. What lies below a piece's last turn comes from the sums of the conversation's later pieces.

A node's conversations that end there are hashed in ascending order by runs: ranges of (digest, conv_id) join ids to
stretches in parallel, and one pass by digest hashes the stretches, holding one at a time.

Null role or text: empty. Null turn: before all others. Equal turns: ordered by role's and text's hash. Null conv_id: no
conversation, left out. Repeated rows: turns like any other. Empty table: no rows. Very long texts: hashed whole.
Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import numbered, written

#: Turns of a conversation in a piece.
BAND = 1024
_LANES = [f"_sl_d{k}" for k in range(4)]
_NO_ID = int(np.iinfo(np.int64).min)
#: conv_ids joined to one stretch before hashing.
_STRETCH = 4096


def turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (0, 1, ... in its conversation), t0, t1 (hashes of role and text), size (code points of the text)."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    hashes = [F.xxhash64(F.lit(k), F.length(said[0]), *said).alias(f"t{k}") for k in range(2)]
    slim = conversations.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("_sl_turn"), *hashes, F.length(said[1]).cast("long").alias("size"))
    return numbered(slim, ["_sl_turn", "t0", "t1"], "pos", group="conv_id").drop("_sl_turn")


def rebuilt(turns: DataFrame, head: Column, source: Column, heads: int) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations, all conv_ids): each begins with the first ``head`` (of conv_id, under
    ``heads``) turns of conversation ``source`` (of conv_id), and its own turns after its first ``head`` follow."""
    convs = written(turns.groupBy("conv_id").agg(F.count("*").alias("_sl_n")))
    sized = convs.select("conv_id", head.cast("long").alias("_sl_h"), source.alias("_sl_s"))
    of = convs.select(F.col("conv_id").alias("_sl_c"), F.col("_sl_n").alias("_sl_m"))
    plan = written(sized.join(of, F.col("_sl_s") == F.col("_sl_c"), "left").select("conv_id", "_sl_h", "_sl_s", F.least("_sl_h", F.coalesce("_sl_m", F.lit(0))).alias("_sl_k")))
    # Of a source only its first few turns are joined, however long it is.
    first = turns.where(F.col("pos") < heads).withColumnRenamed("conv_id", "_sl_c")
    begun = plan.select("conv_id", "_sl_h", "_sl_s").join(first, (F.col("_sl_s") == F.col("_sl_c")) & (F.col("pos") < F.col("_sl_h"))).select("conv_id", "pos", "t0", "t1", "size")
    # The conversation's plan is as many rows as conversations; a long one's turns are split by AQE's skew join.
    own = turns.join(plan.select(F.col("conv_id").alias("_sl_c"), "_sl_h", "_sl_k"), F.col("conv_id") == F.col("_sl_c"))
    own = own.where(F.col("pos") >= F.col("_sl_h")).select("conv_id", (F.col("pos") - F.col("_sl_h") + F.col("_sl_k")).alias("pos"), "t0", "t1", "size")
    return begun.unionByName(own), convs.select("conv_id")


def _digests(rows: DataFrame, band: int) -> DataFrame:
    """conv_id, band, depth, size, the digest's lanes; for every turn, and for the last turn before each later band."""
    low = F.lit(0xFFFFFFFF)
    pieces = [x for t in ("t0", "t1") for h in [F.xxhash64("pos", t)] for x in (h.bitwiseAND(low), F.shiftrightunsigned(h, 32))]
    cut = rows.select("conv_id", F.floor(F.col("pos") / band).cast("long").alias("band"), (F.col("pos") + 1).alias("depth"), "size", *[p.alias(c) for p, c in zip(pieces, _LANES, strict=True)])
    cut = written(cut)
    # Sums before each band: one row a piece, none for conversations of one piece.
    per = cut.groupBy("conv_id", "band").agg(*[F.sum(c).alias(c) for c in _LANES])
    before = W.partitionBy("conv_id").orderBy("band").rowsBetween(W.unboundedPreceding, -1)
    base = per.select(F.col("conv_id").alias("_sl_c"), F.col("band").alias("_sl_b"), *[F.sum(c).over(before).alias(f"{c}b") for c in _LANES]).where("_sl_b > 0")
    upto = W.partitionBy("conv_id", "band").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    inside = cut.select("conv_id", "band", "depth", "size", *[F.sum(c).over(upto).alias(c) for c in _LANES])
    whole = inside.join(written(base), (F.col("conv_id") == F.col("_sl_c")) & (F.col("band") == F.col("_sl_b")), "left")
    return whole.select("conv_id", "band", "depth", "size", *[(F.col(c) + F.coalesce(f"{c}b", F.lit(0))).alias(c) for c in _LANES])


class NodeTable:
    """Slots for n distinct digests (rows of uint64 lanes) by a minimal perfect hash of cascading bit arrays.

    On each level a digest takes the place its hash names, if no other digest does; the rest go to the next level. A
    slot is the rank of the digest's place among all that are taken. ``slots`` checks the digest kept in the slot."""

    def __init__(self, digests: np.ndarray):
        self.kept = np.empty_like(digests)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        rest, used = digests, 0
        while len(rest):
            size = 2 * len(rest) + 1
            at = self._at(rest, len(self.levels), size)
            count = np.bincount(at, minlength=size)
            taken = count == 1
            rank = used + np.cumsum(taken) - 1
            mine = taken[at]
            self.kept[rank[at[mine]]] = rest[mine]
            self.levels.append((taken, rank))
            used += int(mine.sum())
            if len(self.levels) > 64 and not mine.any():
                raise ValueError("digests are not distinct")
            rest = rest[~mine]

    @staticmethod
    @np.errstate(over="ignore")
    def _at(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        x = np.full(len(digests), (level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        for lane in digests.T:
            x = (x ^ lane) * np.uint64(0xC2B2AE3D27D4EB4F)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def slots(self, digests: np.ndarray) -> np.ndarray:
        """-1 for a digest that is not in the table."""
        out, open_ = np.full(len(digests), -1), np.arange(len(digests))
        for level, (taken, rank) in enumerate(self.levels):
            at = self._at(digests[open_], level, len(taken))
            hit = taken[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        known = out >= 0
        out[known & ~(self.kept[out] == digests).all(axis=1)] = -1
        return out


def _lanes(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    return pdf[names].to_numpy(dtype=np.int64).view(np.uint64)


def _unique(digests: np.ndarray) -> np.ndarray:
    order = np.lexsort(digests.T)
    s = digests[order]
    return s[np.r_[True, (s[1:] != s[:-1]).any(axis=1)]] if len(s) else s


_UP = [f"_sl_u{k}" for k in range(4)]
_COUNTED = "band long, shard long, depth long, " + ", ".join(f"{c} long" for c in (*_LANES, *_UP)) + ", n_convs long, conv_id long, size long"


def _count(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's rows (one a turn and conversation) -> its nodes, with the conversations here that pass through each."""
    digests, conv, depth = _lanes(pdf, _LANES), pdf["conv_id"].to_numpy(), pdf["depth"].to_numpy()
    # Turns of a piece are neighbours; the one before a turn is its parent. A piece's first row only names a parent.
    order = np.lexsort((depth, conv))
    digests, conv, depth, size, real = digests[order], conv[order], depth[order], pdf["size"].to_numpy()[order], pdf["real"].to_numpy()[order]
    table = NodeTable(_unique(digests))
    slot = table.slots(digests)
    n = len(table.kept)
    count, least, long_, deep, parent = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, -1)
    np.add.at(count, slot[real], 1)
    np.minimum.at(least, slot[real], conv[real])
    long_[slot], deep[slot] = size, depth
    child = np.flatnonzero(np.r_[False, (conv[1:] == conv[:-1])])
    parent[slot[child]] = slot[child - 1]
    keep = count > 0
    up = np.where(parent[keep, None] >= 0, table.kept[parent[keep]], 0)
    out = {"band": pdf["band"].iloc[0], "shard": pdf["shard"].iloc[0], "depth": deep[keep]}
    out |= {c: table.kept[keep, k].view(np.int64) for k, c in enumerate(_LANES)} | {c: up[:, k].astype(np.uint64).view(np.int64) for k, c in enumerate(_UP)}
    return pd.DataFrame(out | {"n_convs": count[keep], "conv_id": least[keep], "size": long_[keep]})


_SUMMED = "depth long, " + ", ".join(f"{c} long" for c in _LANES) + ", n_leaves long, saved_tokens long, parent_conv_id long"


def _add_up(pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's nodes with their totals of all shards -> what lies under each here. own: this shard adds its weight.
    real: false for the parents of a piece's first turn, which only name themselves."""
    digests = _lanes(pdf, _LANES)
    table = NodeTable(_unique(digests))
    slot, n = table.slots(digests), len(table.kept)
    saved, leaves, least = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64), np.full(n, _NO_ID)
    np.add.at(saved, slot, pdf["weight"].to_numpy())
    np.add.at(leaves, slot, pdf["leaf"].to_numpy())
    np.maximum.at(least, slot, pdf["least"].to_numpy())
    real, depth = pdf["real"].to_numpy(), pdf["depth"].to_numpy()
    parent, deep = np.full(n, -1), np.zeros(n, dtype=np.int64)
    deep[slot] = depth
    below = real & (depth > 0)
    parent[slot[below]] = table.slots(_lanes(pdf, _UP)[below])
    if (parent[slot[below]] < 0).any():
        raise ValueError("a parent is missing from its shard")
    order = np.argsort(-deep, kind="stable")
    ends = np.flatnonzero(np.r_[deep[order][1:] != deep[order][:-1], True]) + 1 if n else []
    lo = 0
    for hi in np.asarray(ends).tolist():
        at = order[lo:hi]
        at = at[parent[at] >= 0]
        np.add.at(saved, parent[at], saved[at])
        np.add.at(leaves, parent[at], leaves[at])
        lo = hi
    keep = np.zeros(n, dtype=bool)
    keep[slot[real]] = True
    own = np.zeros(n, dtype=bool)
    own[slot[pdf["own"].to_numpy()]] = True
    named = np.where(own & (parent >= 0), least[parent], _NO_ID)
    out = {"depth": deep[keep]} | {c: table.kept[keep, k].view(np.int64) for k, c in enumerate(_LANES)}
    return pd.DataFrame(out | {"n_leaves": leaves[keep], "saved_tokens": saved[keep], "parent_conv_id": named[keep]})


def _ends(members: DataFrame) -> DataFrame:
    """(conv_id, digest) of each conversation's last node -> digest, ends_sha256."""
    n = len(_LANES)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lanes, ids = np.stack([b.column(c).to_numpy() for c in _LANES], axis=1), b.column("conv_id").to_numpy()
            new = np.r_[True, (lanes[1:] != lanes[:-1]).any(axis=1)] if len(ids) else np.zeros(0, dtype=bool)
            begin = np.flatnonzero(new)
            size = np.diff(np.r_[begin, len(ids)])
            cuts = np.concatenate([np.arange(lo, lo + k, _STRETCH) for lo, k in zip(begin.tolist(), size.tolist(), strict=True)]) if len(begin) else begin
            text, stops = list(map(str, ids.tolist())), [*cuts[1:].tolist(), len(ids)]
            yield pa.RecordBatch.from_arrays([*(pa.array(lanes[cuts, k]) for k in range(n)), pa.array(ids[cuts]), pa.array([",".join(text[x:y]) for x, y in zip(cuts.tolist(), stops, strict=True)], pa.string())], names=[*_LANES, "first", "ids"])

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.array([d[k] for d, _ in done], pa.int64()) for k in range(n)), pa.array([h for _, h in done], pa.string())], names=[*_LANES, "ends_sha256"])

        for b in batches:
            for *digest, ids in zip(*(b.column(c).to_pylist() for c in (*_LANES, "ids")), strict=True):
                if digest != now:
                    if now is not None:
                        done.append((now, state.hexdigest()))
                    now, state = digest, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield out()
            done.clear()
        if now is not None:
            done.append((now, state.hexdigest()))
        yield out()

    schema = ", ".join(f"{c} long" for c in _LANES)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = members.repartitionByRange(parts, *_LANES, "conv_id").sortWithinPartitions(*_LANES, "conv_id").mapInArrow(join, f"{schema}, first long, ids string")
    return joined.repartition(*_LANES).sortWithinPartitions(*_LANES, "first").mapInArrow(hash_, f"{schema}, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, band: int = BAND, shard_rows: int = 200_000) -> DataFrame:
    """turns (conv_id, pos, t0, t1, size) and all conv_ids (with or without turns) -> the nodes: conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    lit = [F.lit(0).cast("long").alias(c) for c in _LANES]
    rows = _digests(turns, band)
    root = convs.select("conv_id", F.lit(0).cast("long").alias("band"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("size"), *lit)
    rows = written(rows.unionByName(root))
    n_rows = rows.count()
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // shard_rows))
    shard = F.pmod(F.xxhash64("conv_id", "band"), F.lit(shards)).alias("shard")
    # The last turn of a full piece goes along with the next one, as its first turn's parent.
    real = rows.withColumn("real", F.lit(True)).unionByName(rows.where((F.col("depth") == (F.col("band") + 1) * band)).withColumn("band", F.col("band") + 1).withColumn("real", F.lit(False)))
    parts = written(real.select("*", shard).groupBy("band", "shard").applyInPandas(_count, _COUNTED))
    node = parts.groupBy("depth", *_LANES).agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("least"), F.max("size").alias("size"), *[F.max(u).alias(u) for u in _UP])
    children = node.where("depth > 0").groupBy((F.col("depth") - 1).alias("_sl_cd"), *[F.col(u).alias(f"{u}c") for u in _UP]).agg(F.count("*").alias("n_children"))
    of = [F.col("depth") == F.col("_sl_cd"), *[F.col(c) == F.col(f"{u}c") for c, u in zip(_LANES, _UP, strict=True)]]
    node = written(node.join(children, of, "left").select("depth", *_LANES, *_UP, "n_convs", "least", F.coalesce("n_children", F.lit(0)).alias("n_children"), ((F.col("n_convs") - 1) * F.col("size")).alias("weight")))
    # What the pieces after it add to a conversation's piece, at its last node.
    leaf = (F.col("n_children") == 0).cast("long")
    at_band = F.floor((F.col("depth") - 1) / band).cast("long")
    edge = rows.where((F.col("depth") > 0) & (F.col("depth") % band == 0))
    per = node.where(F.col("depth") > band).select(F.col("least").alias("conv_id"), at_band.alias("band"), "weight", leaf.alias("leaf"))
    per = per.unionByName(edge.select("conv_id", (F.col("band") + 1).alias("band"), F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("leaf")))
    per = per.groupBy("conv_id", "band").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf"))
    after = W.partitionBy("conv_id").orderBy(F.desc("band")).rowsBetween(W.unboundedPreceding, 0)
    below = per.select("conv_id", F.col("band").alias("_sl_b"), F.sum("weight").over(after).alias("weight"), F.sum("leaf").over(after).alias("leaf"))
    known = [f"n_{k}" for k in range(len(_LANES))]
    total = node.select(F.col("depth").alias("n_d"), *[F.col(c).alias(k) for c, k in zip(_LANES, known, strict=True)], "least", F.col("weight").alias("_sl_w"), leaf.alias("_sl_l"))
    here = [F.col("depth") == F.col("n_d"), *[F.col(c) == F.col(k) for c, k in zip(_LANES, known, strict=True)]]
    own = F.col("conv_id") == F.col("least")
    mine = parts.join(total, here).select("band", "shard", "depth", *_LANES, *_UP, "least", F.when(own, F.col("_sl_w")).otherwise(0).alias("weight"), F.when(own, F.col("_sl_l")).otherwise(0).alias("leaf"), own.alias("own"), F.lit(True).alias("real"))
    # Later pieces: an owned piece's sums are added at its conversation's last turn in every band before.
    up0 = [F.lit(0).cast("long").alias(u) for u in _UP]
    ghosts = edge.select((F.col("band") + 1).alias("band"), F.pmod(F.xxhash64("conv_id", F.col("band") + 1), F.lit(shards)).alias("shard"), "depth", *_LANES).distinct()
    ghosts = ghosts.join(total, here).select("band", "shard", "depth", *_LANES, *up0, "least", F.lit(0).cast("long").alias("weight"), F.lit(0).cast("long").alias("leaf"), F.lit(False).alias("own"), F.lit(False).alias("real"))
    tails = edge.join(below.withColumnRenamed("conv_id", "_sl_c"), (F.col("conv_id") == F.col("_sl_c")) & (F.col("band") + 1 == F.col("_sl_b")))
    tails = tails.select("band", shard, "depth", *_LANES, *up0, F.lit(_NO_ID).cast("long").alias("least"), "weight", "leaf", F.lit(False).alias("own"), F.lit(False).alias("real"))
    tails = tails.groupBy("band", "shard", "depth", *_LANES, *_UP, "least", "own", "real").agg(F.sum("weight").alias("weight"), F.sum("leaf").alias("leaf"))
    put = mine.unionByName(ghosts).unionByName(tails)
    sums = put.groupBy("band", "shard").applyInPandas(_add_up, _SUMMED).groupBy("depth", *_LANES).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("parent_conv_id").alias("parent_conv_id"))
    last = rows.groupBy("conv_id").agg(F.max(F.struct("depth", *_LANES)).alias("_sl_e")).select("conv_id", *[f"_sl_e.{c}" for c in _LANES])
    none = F.lit(hashlib.sha256(b"").hexdigest())
    # A digest fits one depth only, so the lanes alone name a node.
    out = node.select(F.col("least").alias("conv_id"), "depth", *_LANES, "n_convs", "n_children").join(sums.drop("depth"), _LANES).join(_ends(written(last)), _LANES, "left")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
