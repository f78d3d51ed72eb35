"""The prefix trie against dictionaries of tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.llm import prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(ts)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
        ends[tuple(ts)].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = sum(saved[x] for x in children[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    hashed = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), leaves[k], saved[k], hashed(k)) for k, m in members.items())


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


def query(df, **how):
    c = F.col("conv_id")
    rows, convs = prefix_trie.rebuilt(prefix_trie.turns(df), F.crc32(c.cast("string").cast("binary")) % 6, c - c % 100, heads=5)
    return prefix_trie.trie(rows, convs, **how)


@pytest.mark.parametrize(("band", "shard_rows"), [(1024, 200_000), (3, 10), (1, 5)])
def test_equal_to_tuples(spark, band, shard_rows):
    r = random.Random(band)
    rows = []
    for c in [*range(0, 40), *range(100, 130), *range(205, 230), -250, 777]:
        for t in range(r.choice([1, 2, 3, 6, 11])):
            rows.append((c, t, r.choice(["user", "user", None]), r.choice(["hi", "hi", "hi there", "", None, "é中"])))
    rows += [(100, None, "user", "first"), (None, 1, "user", "lost"), (3, 50, None, None)]
    rows += [(5, 100 + k, "u", "x" * 50) for k in range(40)] + [(6, 100 + k, "u", "x" * 50) for k in range(30)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"band": F.lit(1), "depth": F.lit("x"), "size": F.lit(2.0)}).repartition(4)
    assert got(query(df, band=band, shard_rows=shard_rows)) == brute(brute_rebuilt(rows))


def test_many_copies_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_STRETCH", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(1000, 1120) for t in range(8)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert got(query(df)) == brute(brute_rebuilt(rows))
    assert query(df.limit(0)).count() == 0


def test_slots_are_minimal_perfect_and_checked():
    r = np.random.default_rng(1)
    digests = r.integers(0, 1 << 40, (5000, 4)).astype(np.uint64)
    table = prefix_trie.NodeTable(digests)
    slots = table.slots(digests)
    assert sorted(slots.tolist()) == list(range(5000))
    assert (table.kept[slots] == digests).all()
    assert (table.slots(digests + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError, match="distinct"):
        prefix_trie.NodeTable(np.zeros((2, 4), dtype=np.uint64))
