"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from speechlake.llm import spelling

COLUMNS = ("word", "form", "root", "n", "n_near", "form_n")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_counts(rows, every=31):
    n = Counter()
    for d, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if c.isascii() else c for c in r)
            h = zlib.crc32(f"{'' if d is None else d}:{r}".encode())
            if h % every == 0:
                r = r[: h % len(r)] + r[h % len(r) + 1 :]
            n[r] += 1
    return n


def brute(n, ratio=10):
    form, count = {}, {}
    for w in n:
        mates = [v for v in n if near(w, v)]
        count[w] = len(mates)
        best = min(mates, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select(*COLUMNS).collect())


@pytest.mark.parametrize("crowd", [4, 64, 1 << 20])
def test_equal_to_all_pairs(spark, crowd):
    r = random.Random(crowd)
    base = ["".join(r.choice("abé") for _ in range(r.randrange(7, 11))) for _ in range(150)] + ["x" * k for k in range(7, 40)]
    n = {w: r.choice([2, 3, 20, 25, 300, 4000]) for w in base}
    n |= {w[:5] + r.choice("abz") + w[5 + (i % 2) :]: 2 for i, w in enumerate(base)}
    n |= {"q" * 3000: 50, "q" * 2999: 5, "中文abcdefg": 30, "中abcdefg": 3}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long").repartition(3)
    assert got(spelling.variants(words, crowd=crowd)) == brute(n)
    pairs = [tuple(p) for p in spelling.near_pairs(words, crowd).select("a", "b").collect()]
    assert len(pairs) == len(set(pairs)) == sum(near(a, b) for a in n for b in n if a < b)


def test_whole_texts(spark, odd, none):
    r = random.Random(8)
    stock = ["committee", "government", "necessary", "Àccentés", "separately"]
    texts = [(i, " ".join(r.choice(stock) + r.choice(["", "", "1", "×", " x"]) for _ in range(r.randrange(400)))) for i in range(60)] + [(None, "government committee"), (7, None), (8, "")]
    texts += texts[:2]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = {w: k for w, k in brute_counts(texts).items() if len(w) >= 7 and k >= 2}
    assert got(spelling.group(docs)) == brute(want)
    assert any(f for _, f, *_ in brute(want))
    rows = [(x["doc_id"], x["text"]) for x in odd.collect()]
    assert got(spelling.group(odd)) == brute({w: k for w, k in brute_counts(rows).items() if len(w) >= 7 and k >= 2})
    assert spelling.group(none).count() == 0


def test_chain_of_forms(spark):
    n = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefghijk": 20000}
    words = spark.createDataFrame(sorted(n.items()), "word string, n long")
    assert got(spelling.variants(words)) == brute(n)
    assert {r["root"] for r in spelling.variants(words).collect()} == {"abcdefghijk"}
