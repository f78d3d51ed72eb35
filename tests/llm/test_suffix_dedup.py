"""Suffix-array dedup against a dictionary of all windows."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from speechlake.llm import suffix_dedup
from speechlake.llm.suffix_dedup import carried, equal_runs

COLUMNS = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def brute(rows, length):
    last = 1 << 62
    texts = [(last if d is None else d, (t or "").encode()) for d, t in rows]
    least = {}
    for d, b in texts:
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            least[w] = min(d, least.get(w, d))
    out = []
    for (real, _), (d, b) in zip(rows, texts, strict=True):
        gone, seen = np.zeros(len(b), dtype=bool), set()
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if least[w] < d or w in seen:
                gone[i : i + length] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out.append((real, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, x) for x in r))


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=lambda r: tuple((x is None, x) for x in r))


def made(seed, n):
    """Random texts with copied stretches, edits, short periods, repeated rows and null ids."""
    r = random.Random(seed)
    say = lambda k: "".join(r.choice("abcdefgh é") for _ in range(k))
    common, stock = say(70), [say(200) for _ in range(4)]
    rows = [(0, "a" * 150), (1, "ab" * 90), (2, "ab" * 40 + "x" + "ab" * 40), (3, None), (4, ""), (5, say(19)), (5, "a" * 40)]
    for i in range(6, n):
        text = say(r.randrange(60))
        for _ in range(r.randrange(4)):
            s = r.choice(stock)
            lo = r.randrange(150)
            piece = list(s[lo : lo + r.randrange(20, 120)])
            if r.random() < 0.5:
                piece[r.randrange(len(piece))] = r.choice("xyz")
            text += "".join(piece) + say(r.randrange(30)) + (common if r.random() < 0.5 else "")
        rows.append((r.choice([i, i, i, i // 2, None]) if i % 7 == 0 else i, text))
    return rows + rows[10:13]


@pytest.mark.parametrize(("seed", "hot"), [(1, 1 << 30), (2, 3), (3, 0)])
def test_equal_to_all_windows(spark, seed, hot):
    rows = made(seed, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(suffix_dedup.dedup(docs, length=20, gram=8, hot=hot)) == brute(rows, 20)


def test_at_100_bytes(spark):
    r = random.Random(5)
    say = lambda k: " ".join("".join(r.choice("aeioustnr") for _ in range(r.randrange(2, 9))) for _ in range(k))
    stock = [say(60) for _ in range(5)]
    rows = [(i, say(20) + " " + r.choice(stock) + r.choice(["", " ", "!"]) + say(15) + r.choice(stock)) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffix_dedup.dedup(docs)) == brute(rows, 100)
    assert got(suffix_dedup.dedup(docs, hot=2, per_bucket=50)) == brute(rows, 100)


def test_odd_rows(spark, odd, none):
    rows = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    assert got(suffix_dedup.dedup(odd)) == brute(rows, 100)
    assert suffix_dedup.dedup(none).count() == 0
    with pytest.raises(ValueError, match="gram"):
        suffix_dedup.dedup(none, length=10, gram=20)


def test_equal_runs():
    r = random.Random(3)
    text = bytes(r.choice(b"ab") for _ in range(3000))
    at = np.arange(len(text) - 21)
    pick, run = equal_runs(text, at, 21)
    groups = {}
    for i in at.tolist():
        groups.setdefault(text[i : i + 21], set()).add(i)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = {}
    for i, k in zip(pick.tolist(), run.tolist(), strict=True):
        found.setdefault(k, set()).add(i)
    assert {frozenset(g) for g in found.values()} == want
    keys = [text[i : i + 21] for i in pick.tolist()]
    assert keys == sorted(keys)


def test_carried_over_boundaries():
    edges = [(0, b"a", b"c", False, 7, 0, 1), (1, b"c", b"c", True, 9, 0, 2), (3, b"c", b"d", False, 4, 1, 0), (4, b"e", b"e", True, 1, 1, 1)]
    assert carried(edges) == [(1, 7, 0, 1), (3, 7, 0, 2)]


@pytest.mark.parametrize("block", [1, 7, 1 << 17])
def test_spans_hold_every_window_once(monkeypatch, block):
    """Each window of a document is in one span, whose anchor lies in the window and depends on its bytes alone."""
    monkeypatch.setattr(suffix_dedup, "_BLOCK", block)
    texts = [t.encode() for _, t in made(4, 40) if t is not None]
    b = suffix_dedup.Spans(list(range(len(texts))), list(map(len, texts)), b"".join(texts), 20, 8)
    ends, found, offset = np.cumsum(b.sizes), [], {}
    for first, last, anchor, row in zip(b.first.tolist(), b.last.tolist(), b.anchor.tolist(), b.row.tolist(), strict=True):
        assert first <= last <= anchor <= first + 20 - 8
        found += range(first, last + 1)
        for x in range(first, last + 1):
            assert ends[row] - b.sizes[row] <= x and x + 20 <= ends[row]
            w = b.body[x : x + 20].tobytes()
            assert offset.setdefault(w, anchor - x) == anchor - x
    assert sorted(found) == [x for e, n in zip(ends.tolist(), b.sizes.tolist(), strict=True) for x in range(e - n, e - 20 + 1)]


def test_buckets_of_anchors_are_even():
    r = random.Random(5)
    body = bytes(r.choice(b"abcdefgh ") for _ in range(300_000))
    m = suffix_dedup.Spans([1], [len(body)], body, 100, 40).kinds()[0]
    sizes = [hi - lo for _, lo, hi in suffix_dedup._cuts(m, 6)]
    assert len(sizes) == 64 and max(sizes) < 1.5 * len(m) / 64
