"""Each operator against a brute-force form, on odd rows and on empty tables."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from speechlake.llm import bestfit_packing, decontamination, line_dedup, quality_rules, simhash_balls, substring_dedup, token_counts, token_planes, url_rules, vector_sharding
from speechlake.llm.common import components, remembered, scratch, written
from speechlake.llm.queries import vocabulary

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def key(row):
    return tuple((x is None, x) for x in row)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=key)


# 1 quality rules


def brute_counts(text):
    w, places = words(text), defaultdict(list)
    for i in range(len(w) - 4):
        places[tuple(w[i : i + 5])].append(i)
    covered = {p for at in places.values() if len(at) > 1 for i in at for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (None, 1, None), (99, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(odd.drop("n_words"), labels)
    want = sorted(((r["doc_id"], *brute_counts(r["text"])) for r in odd.collect()), key=key)
    assert rows_of(got, "doc_id", *quality_rules.BASE) == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert not r["kept"] if r["base_failed"] else r["kept"]  # so few labels certify nothing
    assert quality_rules.judge(none, labels).count() == 0


def test_quality_cutoffs_hold_the_risk(spark):
    """Bad documents are full of symbols; a cutoff is certified only where labels suffice."""
    rnd = random.Random(3)
    texts = [(i, " ".join(("w%d" % rnd.randrange(9999)) + ("###" if i % 5 == 0 else "") for _ in range(30)), "en" if i % 3 else "fr") for i in range(3000)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(3000) if i % 3 or i < 300], "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, labels).collect()
    for r in got:
        assert r["kept"] == (r["lang"] == "fr" or r["doc_id"] % 5 != 0)


def test_binomial_tail(spark):
    from pyspark.sql import functions as F

    cases = [(0, 100), (3, 500), (2, 2000), (9, 1000), (40, 300)]
    df = spark.createDataFrame(cases, "k long, n long").withColumn("p", quality_rules.binomial_tail(F.col("k"), F.col("n"), 0.0125))
    for r in df.collect():
        exact = sum(comb(r["n"], j) * 0.0125**j * 0.9875 ** (r["n"] - j) for j in range(r["k"] + 1))
        assert r["p"] == pytest.approx(1.0 if r["k"] >= r["n"] * 0.0125 else exact, rel=1e-9)


def test_quality_is_native(spark, odd):
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    plan = quality_rules.judge(odd.drop("n_words"), labels)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# 2 bit planes


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes):
    rnd = np.random.default_rng(1)
    for n in (0, 1, 7, 64, 1000, 4097):
        ids = rnd.integers(0, 1 << 31, n).astype("<u4")
        payload, sizes = token_planes.to_planes(ids, 512, planes)
        assert np.array_equal(token_planes.from_planes(payload, sizes, n, 512, planes), ids)


def test_token_files(spark, odd, none):
    path = scratch(spark)
    token_planes.write(odd, path, vocabulary("byte_bpe_50k.json"), block=1000)
    t, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc, text in sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((doc, len(ids), ids))
    got = [(r["doc_id"], r["n_tokens"], np.frombuffer(r["ids"], dtype="<u4").tolist(), r["start"]) for r in token_planes.read(spark, path).collect()]
    got.sort(key=lambda r: r[3])
    assert [r[0] for r in got] == [r[0] for r in want]
    assert sorted((key((a,)), b, c) for a, b, c, _ in got) == sorted((key((a,)), b, c) for a, b, c in want)
    for _, n, _, at in got:
        assert at == start
        start += n
    empty = scratch(spark)
    token_planes.write(none, empty, vocabulary("byte_bpe_50k.json"))
    assert token_planes.read(spark, empty).count() == 0


# 3 sharding


def test_sharding(spark, odd, none):
    many = [(i, "copy " * 50) for i in range(700)] + [(1000 + i, f"text {i} " * (1 + i % 40)) for i in range(1300)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    got = vector_sharding.shard(docs, shards=8).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(got) == len(many) and sizes.max() <= 1.03 * sizes.mean() and sizes.min() >= 0.97 * sizes.mean()
    for _, s in got.groupby("shard"):
        assert sorted(s["slot"]) == list(range(len(s)))
    light = got[got.doc_id >= 1000].merge(docs.toPandas(), on="doc_id")
    assert (light.groupby("text")["shard"].nunique() == 1).all()
    few = vector_sharding.shard(odd)
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect()), key=key)
    assert rows_of(few, "doc_id", "size", "text_crc32") == want
    assert vector_sharding.shard(none).count() == 0


# 4 decontamination


def test_decontamination(spark, odd, none):
    rnd = random.Random(5)
    vocab = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rnd.choices(vocab, k=30))) for i in range(20)] + [(20, None), (21, "two words"), (22, "")]
    docs, truth = [], set()
    for d in range(300):
        text = rnd.choices(vocab, k=120)
        if d % 3 == 0:  # a leak; a hot item leaks often
            i = 7 if d % 2 else rnd.randrange(20)
            copy = items[i][1].split()
            for _ in range(d % 4):
                copy[rnd.randrange(30)] = "edited"
            text[40:40] = copy
            truth.add((d, i))
        docs.append((d, ", ".join(text).upper()))
    docs += [(400, None), (401, ""), (None, items[3][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = decontamination.hits(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in hits.collect()} == truth | {(None, 3)}
    blocks = decontamination.hits(df, bench, block_bytes=500)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == truth | {(None, 3)}
    kept = decontamination.clean(df, bench)
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in truth} - {None}
    assert decontamination.hits(none, bench).count() == 0 and decontamination.clean(odd, bench.where("false")).count() == odd.count()


def test_every_fifth_word_edited(spark):
    """Intact 3-grams count as seeds whether the item occurs elsewhere or not."""
    rnd = random.Random(8)
    vocab = [f"v{i}" for i in range(500)]
    item = rnd.sample(vocab, 40)
    copies = [" ".join(["other", "words", *(f"edit{i}" if i % 5 == at else w for i, w in enumerate(item)), "follow"]) for at in range(5)]
    # Intact 3-grams are commoner than the broken ones.
    parts = [(100 + i, " ".join(item[i : i + 4])) for at in range(5) for i in range(at + 1, 37, 5) for _ in range(2)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    twice = (50, f"{' '.join(item)} {' '.join(item[3:8] + ['far'] * 9) * 3} {copies[0]}")
    for more in ([], [(60, " ".join(item))]):
        rows = [*enumerate(copies), *parts, twice, *more]
        found = Counter(r["doc_id"] for r in decontamination.hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect())
        assert found == Counter([0, 1, 2, 3, 4, 50, 50, *(d for d, _ in more)])


def test_copies_side_by_side_and_very_long_items(spark):
    """Every copy is a hit of its own, and memory does not grow with item times zone."""
    rnd = random.Random(4)
    vocab = [f"v{i}" for i in range(5000)]
    item, long_item = rnd.choices(vocab, k=30), rnd.choices(vocab, k=4000)
    rows = [(1, " ".join(item * 3)), (2, " ".join(item * 400)), (3, " ".join(["own"] * 9 + long_item[:3000] + ["far"] * 5)), (4, " ".join(rnd.choices(vocab, k=9000)))]
    bench = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(long_item))], "item_id long, text string")
    hits = decontamination.hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert Counter((r["doc_id"], r["item_id"]) for r in hits) == {(1, 7): 3, (2, 7): 400, (3, 8): 1}
    assert sorted((r["start_word"], r["end_word"]) for r in hits if r["doc_id"] == 2) == [(30 * i, 30 * i + 30) for i in range(400)]
    assert [(r["start_word"], r["end_word"]) for r in hits if r["doc_id"] == 3] == [(9, 3009)]


def test_decontamination_against_all_alignments(spark):
    """Each document against each item by the full matrix: whatever scores is found, as long as three words in a row stay."""
    rnd = random.Random(17)
    vocab = [f"w{i}" for i in range(60)]
    items = [(i, rnd.choices(vocab, k=rnd.randint(8, 25))) for i in range(12)]
    docs = []
    for d in range(60):
        text = rnd.choices(vocab, k=rnd.randint(0, 50))
        if d % 2:
            copy = [x for w in rnd.choice(items)[1] for x in ([w] if rnd.random() < 0.85 else rnd.choice(([], ["new"], [w, "more"])))]
            text[len(text) // 2 : len(text) // 2] = copy
        docs.append((d, text))
    want = set()
    for d, text in docs:
        for i, item in items:
            h = np.zeros((len(item) + 1, len(text) + 1), dtype=int)
            for a, x in enumerate(item):
                for b, y in enumerate(text):
                    h[a + 1, b + 1] = max(0, h[a, b] + (2 if x == y else -1), h[a, b + 1] - 1, h[a + 1, b] - 1)
            threes = {tuple(item[k : k + 3]) for k in range(len(item) - 2)} & {tuple(text[k : k + 3]) for k in range(len(text) - 2)}
            if threes and h.max() >= 1.2 * len(item):
                want.add((d, i))
    df = spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string")
    assert want and {(r["doc_id"], r["item_id"]) for r in decontamination.hits(df, bench).collect()} == want


def test_alignment_is_exact():
    rnd = random.Random(2)
    for _ in range(60):
        a, b = rnd.choices(range(5), k=rnd.randint(1, 9)), rnd.choices(range(5), k=rnd.randint(0, 14))
        h = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i in range(len(a)):
            for j in range(len(b)):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        score, lo, hi = decontamination.align(np.array(a), np.array(b, dtype=int))
        assert score == h.max() and 0 <= lo <= hi <= len(b)
        # The stretch named holds that score.
        assert not score or decontamination.align(np.array(a), np.array(b[lo:hi], dtype=int)) == (score, 0, hi - lo)


# 5 token counts


def test_token_counts(odd, none):
    m = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = token_counts.count(odd, vocabulary("piece_bpe_32k.model"))
    want = sorted(((r["doc_id"], len((r["text"] or "").encode()), n := len(m.encode(r["text"] or "")), n > 4096) for r in odd.collect()), key=key)
    assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == want
    assert token_counts.count(none, vocabulary("piece_bpe_32k.model")).count() == 0


def test_encoders_equal_the_libraries():
    from speechlake.llm.token_counts import PieceCounter
    from speechlake.llm.tokens import Encoder

    rnd = random.Random(11)
    parts = ["a", "B", "'s", "'", "<|endoftext|>", " ", "  ", "\n", "\t", "\r", "\x1c", "\x85", "\xa0", "　", "é", "é", "Σ", "ß", "İ", "1", "東京", "▁", "<s>", "!", "​", "😀", "ſ", "ﬁ", "\x00", "the", "<0x0A>", "'LL", "µ", "²"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 14))) for _ in range(5000)]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        e = Encoder(public_tokenizers.path(name), kind, kept=3000)
        for lo in range(0, len(texts), 500):
            some = texts[lo : lo + 500]
            assert [np.frombuffer(x, dtype="<u4").tolist() for x in e.ids_of(some)] == [x.ids for x in e.tokenizer.encode_batch(some, add_special_tokens=False)]
    c = PieceCounter(public_tokenizers.path("piece_bpe_32k.model"), kept=3000)
    assert c.counts(texts) == [len(x) for x in c.model.encode(texts, num_threads=1)]


# 6 url rules


def brute_url(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    if not m:
        return "", "", None, None
    host, path = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
    fit = [(h + p, v) for v, h, p in url_rules.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fit, key=lambda x: len(x[0])) if fit else (None, None))


def test_url_rules(spark):
    urls = ["http://a.com/en/1", "https://Example.COM/en/", "http://www.example.com/en/x?y", "http://www.example.com/enx", "http://x.net/es/1", "http://x.net/es", "net/fr/", "http://fakecom/", "ftp://example.com/en/#top", None, "", "://", "a://b://c.com/en/", "http://com/"]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], None)], "page_id long, url string, rule string")
    got = url_rules.judge(pages, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    want = sorted(((i, *brute_url(u)) for i, u in [*enumerate(urls), (None, urls[0])]), key=key)
    want = [(i, h, p, r, v or "allow") for i, h, p, r, v in want]
    assert rows_of(got, "page_id", "host", "path", "rule", "verdict") == sorted(want, key=key)
    assert url_rules.judge(pages.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_mined_rules_against_brute_force(spark):
    from itertools import combinations

    rnd = random.Random(4)
    urls = [(i, f"http://{rnd.choice(['ads', 'blog', 'm'])}.{rnd.choice(['spam', 'good', 'mid'])}.org/{rnd.choice(['x', 'y', 'z'])}/{i}") for i in range(900)]
    bad = {i for i, u in urls if "spam" in u and "ads" in u and rnd.random() < 0.95 or rnd.random() < 0.05}
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in urls if i % 2], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels, min_count=10)
    from pyspark.sql import functions as F

    tokens = {r[0]: frozenset(r[1]) for r in pages.select("page_id", url_rules.tokens(url_rules.host(F.col("url")), url_rules.path(F.col("url")))).collect()}
    n, hit = Counter(), Counter()
    for i, _ in urls:
        if i % 2:
            for k in range(1, 5):
                for c in combinations(sorted(tokens[i]), k):
                    n[c] += 1
                    hit[c] += i in bad
    rules = {c: hit[c] / n[c] for c in n if hit[c] >= 10 and hit[c] / n[c] >= 0.8}
    assert rules
    blocked = {i for i, t in tokens.items() if any(set(c) <= t for c in rules)}
    assert {r["page_id"] for r in got.where("verdict = 'block'").collect()} == blocked


# 7 substring dedup


def brute_substrings(docs, window):
    first = {}
    for d, text in docs:
        w = words(text)
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            first[g] = min(first.get(g, float("inf")), float("inf") if d is None else d)
    out = []
    for d, text in docs:
        w = words(text)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (float("inf") if d is None else d):
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_substring_dedup(spark, odd, none, window):
    got = substring_dedup.dedup(odd, window=window)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings([(r["doc_id"], r["text"]) for r in odd.collect()], window)
    assert substring_dedup.dedup(none, window=window).count() == 0


def test_substring_dedup_random(spark):
    rnd = random.Random(8)
    base = [rnd.choices("abcdefgh", k=40) for _ in range(5)]
    docs = [(i, " ".join(x for _ in range(rnd.randint(0, 4)) for x in rnd.choice(base)[rnd.randint(0, 20) :])) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    assert rows_of(substring_dedup.dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256") == brute_substrings(docs, 13)


# 8 packing


def test_best_fit_packing(spark, odd, none):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = bestfit_packing.pack_documents(odd, vocabulary("word_bpe_49k.json")).toPandas()
    want = []
    for r in odd.collect():
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(r["doc_id"], k, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    mine = [(None if d != d else int(d), *map(int, rest)) for d, *rest in got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)]
    assert sorted(mine, key=key) == sorted(want, key=key)
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 2048
    assert bestfit_packing.pack_documents(none, vocabulary("word_bpe_49k.json")).count() == 0


def test_rounds_close_gaps(spark):
    rnd = random.Random(6)
    lengths = [rnd.randint(1, 99) for _ in range(3000)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lengths)], "i long, length long")
    got = bestfit_packing.pack(df, 100, cell=300).toPandas()
    assert len(got) == len(lengths) and (got.groupby("sequence_id").length.sum() <= 100).all()
    whole = bestfit_packing.best_fit(np.sort(lengths)[::-1], 100)[0].max() + 1
    assert got.sequence_id.nunique() <= 1.02 * whole and got.sequence_id.nunique() >= bestfit_packing.least_bins(np.array(lengths), 100)


def test_bounds_never_exceed_a_packing():
    rnd = random.Random(9)
    for _ in range(300):
        c = rnd.randint(4, 60)
        x = np.array(sorted((rnd.randint(1, c) for _ in range(rnd.randint(1, 60))), reverse=True))
        assert bestfit_packing.least_bins(x, c) <= bestfit_packing.best_fit(x, c)[0].max() + 1
    assert bestfit_packing.least_bins(np.array([6] * 5), 10) == 5


# 9 line dedup


def brute_lines(docs, min_words=5, similarity=0.8):
    norm = lambda x: " ".join(w for p in x.lower().split(" ") if (w := p.strip(line_dedup.PUNCTUATION)))
    seen = {(d, t) for d, t in docs if t is not None}
    places = sorted(((d is None, d or 0, d, t, i, norm(x)) for d, t in seen for i, x in enumerate(t.split("\n"))), key=lambda p: (p[0], p[1], p[4]))
    places = [p for p in places if len(p[5].split(" ")) >= min_words]

    def fp(line):
        h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in line.split(" ")]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    lines = sorted({p[5] for p in places})
    fps, root = [fp(x) for x in lines], list(range(len(lines)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(lines)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and edits(lines[i].split(), lines[j].split()) <= int((1 - similarity) * max(len(lines[i].split()), len(lines[j].split())) + 1e-9):
                root[find(i)] = find(j)
    of = {x: find(i) for i, x in enumerate(lines)}
    kept, gone = {}, defaultdict(set)
    for p in places:
        if kept.setdefault(of[p[5]], p) is not p:
            gone[(p[2], p[3])].add(p[4])
    return gone


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_line_dedup(spark, none):
    rnd = random.Random(12)
    vocab = [f"term{i:03d}" for i in range(400)]
    base = [rnd.choices(vocab, k=rnd.randint(3, 60)) for _ in range(40)]
    docs = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(1, 6)):
            line = list(rnd.choice(base))
            if rnd.random() < 0.5 and len(line) > 30:
                line[rnd.randrange(len(line))] = rnd.choice(["changed", "termx", "123", "9,9"])
            lines.append(" ".join(line) if rnd.random() < 0.7 else "  ".join(line).upper() + "!")
        docs.append((d, "\n".join(lines)))
    docs += [(100, None), (101, ""), (102, "\n\n"), (None, docs[0][1]), (3, docs[3][1])]
    df = spark.createDataFrame([(d, t, "z") for d, t in docs], "doc_id long, text string, line string")
    gone = brute_lines(docs)
    want = []
    for d, t in docs:
        drop = gone[(d, t)]
        want.append((d, None if t is None else t if not drop else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in drop), len(drop)))
    assert any(n for _, _, n in want)
    assert rows_of(line_dedup.dedup(df), "doc_id", "text", "_sl_removed") == sorted(want, key=key)
    assert line_dedup.dedup(none).count() == 0


def test_line_dedup_odd_rows(odd):
    assert line_dedup.dedup(odd.drop("_r")).count() == odd.count()


def full_removed(spark, lines):
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return [r["_sl_removed"] for r in line_dedup.dedup(df, full=True).orderBy("doc_id").collect()]


def test_full_line_dedup_finds_all_similar(spark):
    """Against edit similarity alone: words changed, added or left out up to a fifth."""
    rnd = random.Random(21)
    vocab = [f"{a}{b}{c}" for a in "bdfgklmnpr" for b in "aeiou" for c in "xyzvw"]
    lines = []
    for k in range(0, 60, 3):
        line = rnd.choices(vocab, k=6 + k)
        lines.append(" ".join(line))
        for at in rnd.sample(range(len(line)), len(line) // 5):
            line[at] = "elsewhere" if rnd.random() < 0.8 else ""
        lines.append(" ".join(w for w in line if w))
    root = list(range(len(lines)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i, x in enumerate(lines):
        for j, y in enumerate(lines[:i]):
            if edits(x.split(), y.split()) <= int(0.2 * max(len(x.split()), len(y.split())) + 1e-9) or (Counter(x) - Counter(y)).total() <= 0.2 * max(len(x), len(y)) and edits(x, y) <= int(0.2 * max(len(x), len(y)) + 1e-9):
                root[find(i)] = find(j)
    kept, want = set(), []
    for i in range(len(lines)):
        want.append(int(find(i) in kept))
        kept.add(find(i))
    got = full_removed(spark, lines)
    assert sum(want) > 15 and [(i, x) for i, x in enumerate(lines) if got[i] != want[i]] == []


def test_full_line_dedup_short_and_unspaced(spark):
    lines = ["Read more", "read  more!", "12", "13", "", "", "今天天气很好我们一起去公园散步吧", "今天天气真好我们一起去公园散步吧", "Read most"]
    assert full_removed(spark, lines) == [0, 1, 0, 0, 0, 0, 0, 1, 0]


def test_full_line_dedup_digits_separators_typos(spark):
    lines = ["updated on 3 May 2024 at 10:15 by admin", "updated on 28 May 2023 at 9:07 by admin", "left,right and/or centre of things", "left right and or centre of things"]
    lines += ["wonderful mountain railway journeys through switzerland", "wonderfal mountain railway journays through switzerland", "1 2 3 4 5 6", "70 80 90 10 20 30"]
    assert full_removed(spark, lines) == [0, 1, 0, 1, 0, 1, 0, 0]


def test_block_masks_meet():
    rnd = random.Random(1)
    for n in (10, 10**6, 10**9):
        masks = line_dedup.block_masks(n)
        for _ in range(200):
            d = sum(1 << b for b in rnd.sample(range(64), 3))
            assert any(not d & m for m in masks)


# 10 simhash


def brute_fp(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_classes(spark, odd, none):
    got = {(r["doc_id"], r["fp"] % (1 << 64)): r["component_id"] for r in simhash_balls.classes(odd).collect()}
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert set(got) == {(d, brute_fp(t)) for d, t in docs}
    same = {got[(d, brute_fp(t))] for d, t in docs if t and t.startswith("the quick brown fox jumps over the lazy dog while seven wizards brew a potion of mint tea") and "\n" not in t}
    assert same == {0}
    assert simhash_balls.classes(none).count() == 0
    kept = simhash_balls.dedup(odd.select("doc_id", "text"))
    assert kept.count() == len(set(got.values())) and kept.columns == ["doc_id", "text"]


def test_ball_links_find_all(spark):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = sorted({b ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 6))) for b in base for _ in range(6)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash_balls.links(df, len(fps))).collect()}
    parent = list(range(len(fps)))
    find = lambda x: x if parent[x] == x else find(parent[x])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    for i in range(len(fps)):
        for j in range(i):
            a, b = roots.get(signed[i], signed[i]), roots.get(signed[j], signed[j])
            assert (a == b) == (find(i) == find(j))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(61)} == {0} and {got[1000 + i] for i in range(50)} == {1000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# clashing columns, odd rows in every stage


def test_quality_keeps_own_columns(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven", "en", "mine", None, "k"), (2, None, "en", "mine", 3, "k")], "doc_id long, text string, lang string, n_words string, symbol_bp int, kept string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in quality_rules.good(docs, labels).collect()] == [tuple(docs.first())]


def test_mined_rules_that_chance_does_not_explain(spark):
    """Against a brute force over all combinations with Wilson's bound written out, corrected for their number."""
    from itertools import combinations
    from math import sqrt
    from statistics import NormalDist

    from pyspark.sql import functions as F

    rnd = random.Random(14)
    urls = [(i, f"http://{rnd.choice(['shop', 'blog', 'm'])}.{rnd.choice(['aa', 'b-c', 'cc'])}.org/{rnd.choice(['x1', 'y', 'z'])}/") for i in range(600)]
    bad = {i for i, u in urls if rnd.random() < (0.7 if "shop" in u and "x1" in u else 0.2)}
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i not in bad), 0) for i, _ in urls], "doc_id long, quality int, toxic int")
    got = url_rules.judge(pages, labels, min_confidence=0.3)
    tokens = {r[0]: frozenset(r[1]) for r in pages.select("page_id", url_rules.tokens(url_rules.host(F.col("url")), url_rules.path(F.col("url")))).collect()}
    n, hit = Counter(), Counter()
    for i, own in tokens.items():
        for k in range(1, 5):
            for c in combinations(sorted(own), k):
                n[c] += 1
                hit[c] += i in bad
    base, z = len(bad) / len(urls), NormalDist().inv_cdf(1 - 0.01 / sum(m >= 20 for m in n.values()))

    def low(h, m):
        p = h / m
        return (p + z * z / (2 * m) - z * sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)

    rules = [set(c) for c in n if hit[c] >= 20 and hit[c] / n[c] >= 0.3 and low(hit[c], n[c]) > base]
    want = {i for i, own in tokens.items() if any(c <= own for c in rules)}
    assert want and {r["page_id"] for r in got.where("verdict = 'block'").collect()} == want


def test_no_rules_from_labels_that_mean_nothing(spark):
    """The labels of sf0.1, shuffled 20 times: no confidence floor, and still no rule but by a chance of 1 in 100."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    bad = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.bool_or((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    h, p = url_rules.host(F.col("url")), url_rules.path(F.col("url"))
    rows = pages.join(bad, F.col("page_id") == F.col("doc_id")).select(url_rules.tokens(h, p).alias("tokens"), "bad").collect()
    found = 0
    for seed in range(20):
        flags = [r["bad"] for r in rows]
        random.Random(seed).shuffle(flags)
        labelled = spark.createDataFrame([(r["tokens"], f) for r, f in zip(rows, flags, strict=True)], "tokens array<string>, bad boolean").coalesce(2).cache()
        found += url_rules.mine(labelled, min_confidence=0.0).count() > 0
        labelled.unpersist()
    assert found <= 1


def test_url_rules_odd_labels_and_long_urls(spark):
    """Null labels and ids count for nothing, a very long url is judged whole, columns may have any names."""
    long_url = "http://ads.spam.org/" + "/".join(f"p{i % 50}" for i in range(20000)) + "/end"
    urls = [(i, f"http://{'ads.spam' if i % 2 else 'fine.good'}.org/x/{i % 7}") for i in range(400)] + [(400, long_url), (401, None)]
    pages = spark.createDataFrame([(i, u, "k") for i, u in urls], "page_id long, url string, verdict string")
    labels = spark.createDataFrame([(i, None if i % 3 == 0 else 1 - i % 2, None) for i in range(400)] + [(None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r["verdict"] for r in url_rules.judge(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400)) and got[400] == "block" and got[401] == "allow"


def test_line_dedup_long_lines_ties_and_clashing_columns(spark):
    """A very long line, equal lines in one document, and a column with the result's name."""
    long_line = " ".join(f"w{i}" for i in range(30000))
    rows = [(1, f"{long_line}\nsame words stand in this line\nsame words stand in this line", "own"), (2, long_line + " end", "own"), (2, long_line + " end", "own"), (3, None, None), (4, "", "own")]
    got = line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string, _sl_removed string"), full=True)
    assert sorted((r["doc_id"], r["_sl_removed"], len(r["text"] or "")) for r in got.collect()) == [(1, 1, len(rows[0][1]) - 30), (2, 1, 0), (2, 1, 0), (3, 0, 0), (4, 0, 0)]


def test_dot_product_placement():
    """The choice of each vector by a search over all shards."""
    rnd = np.random.default_rng(3)
    vectors, residual = rnd.random((40, 3)), np.full((5, 3), 9.0)
    mine, left, want = residual.copy(), residual.copy(), []
    got = vector_sharding.place(vectors, mine, first=2)
    for v in vectors:
        best = max(((left[s] * v * vector_sharding.WEIGHTS).sum(), -k, s) for k, s in enumerate([2, 3, 4, 0, 1]))
        want.append(best[2])
        left[best[2]] -= v
    assert got.tolist() == want and np.allclose(mine, left)


def test_components_of_documents_by_brute_force(spark):
    """component_id from texts alone: fingerprints, all pairs within 4 bits, union-find."""
    rnd = random.Random(19)
    base = [rnd.choices([f"t{i}" for i in range(80)], k=60) for _ in range(6)]
    docs = []
    for d in range(60):
        words_ = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 3)):
            words_[rnd.randrange(60)] = "new"
        docs.append((rnd.randrange(10**6), " ".join(words_)))
    fps = [brute_fp(t) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(d, least.get(find(i), d))
    got = simhash_balls.classes(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["component_id"]) for r in got.collect()) == sorted((d, least[find(i)]) for i, (d, _) in enumerate(docs))


def brute_near(docs, similarity=0.8):
    """Groups of texts with word 5-shingles at least so similar, by all pairs."""
    sets = []
    for _, t in docs:
        w = words((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (docs[i][1] or "") == (docs[j][1] or "") or both and both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    return [find(i) for i in range(len(docs))]


def test_near_copies(spark, odd, none):
    rnd = random.Random(23)
    base = [rnd.choices([f"t{i}" for i in range(300)], k=rnd.randint(60, 200)) for _ in range(12)]
    docs = []
    for d in range(80):
        copy = list(rnd.choice(base))
        if d % 3:
            copy[rnd.randrange(len(copy))] = "edited"
        docs.append((1000 - d, " ".join(copy if d % 4 else [w.upper() for w in copy])))
    docs += [(2000, None), (2001, ""), (2002, None), (None, docs[0][1])]
    group = brute_near(docs)
    want = sorted(min((d for (d, _), g in zip(docs, group, strict=True) if g == own and d is not None)) for own in set(group))
    got = simhash_balls.near_copies(spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, fp string"))
    kept = {r["doc_id"] for r in got.collect()}
    # None goes without a similar one that stays; of those that could go nearly all do.
    assert got.columns == ["doc_id", "text", "fp"] and set(want) <= kept and len(kept) - len(want) <= 0.1 * (len(docs) - len(want))
    assert simhash_balls.near_copies(none).count() == 0
    kept = simhash_balls.near_copies(odd)
    assert kept.columns == odd.columns and kept.count() == len(set(brute_near([(r["doc_id"], r["text"]) for r in odd.collect()])))


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Nulls, repeated rows, clashing columns and no rows at all go through every stage."""
    import corpus_pipeline

    for docs in (odd, none):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = spark.createDataFrame(stage(spark, docs, "/root/testdata/sf0.001").collect(), docs.schema)
            assert docs.columns == columns, name
            assert all(r["n_words"] is None and r["_r"] in ("y", None) for r in docs.collect()), name
        corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count()


def test_pack_replaces_clashing_columns(spark):
    df = spark.createDataFrame([(i, 1 + i % 7, "x", "y", "z") for i in range(50)], "i long, length long, offset string, round string, sequence_id string")
    got = bestfit_packing.pack(df, 10).toPandas()
    assert len(got) == 50 and sorted(got.columns) == ["cell_bins", "cell_bound", "i", "length", "offset", "round", "sequence_id"]
    assert (got.groupby("sequence_id").length.sum() <= 10).all() and got.offset.max() < 10


def test_near_copies_of_one_fingerprint(spark):
    """Pairs under a long repeated head: fingerprints differ only where the head leaves a tie, and each text has one near
    copy."""
    rnd = random.Random(31)
    head = " ".join([f"h{i}" for i in range(101)] * 60)
    docs = []
    for k in range(60):
        body = [f"b{k}x{rnd.randrange(10**6)}" for _ in range(90)]
        docs.append((2 * k, head + " " + " ".join(body)))
        body[rnd.randrange(90)] = "edited"
        docs.append((2 * k + 1, head + " " + " ".join(body)))
    prints = [simhash_balls.fingerprint(t.encode(), (1, 2)) for _, t in docs]
    assert sum((a ^ prints[0]).bit_count() <= 4 for a in prints) > 60
    kept = simhash_balls.near_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert sorted(r["doc_id"] for r in kept.collect()) == [2 * k for k in range(60)]


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash_balls.links(spark.createDataFrame([(1,)], "fp long"), 1, radius=3)


def test_decontamination_passages_and_rare_seeds(spark):
    """A verbatim part of 13 words or more is a hit by its own length; seeds avoid an item's commonest words."""
    rnd = random.Random(41)
    item = [f"q{i}" for i in range(70)]
    other = lambda k: [f"z{rnd.randrange(3000)}" for _ in range(k)]
    docs = [(k, " ".join(other(50) + item[20 : 20 + k] + other(50))) for k in (8, 12, 14, 25, 40)]
    docs += [(100, " ".join(other(30) + [w if i % 9 else "edit" for i, w in enumerate(item[5:35])] + other(30)))]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    got = {r["doc_id"]: (r["start_word"], r["end_word"]) for r in decontamination.hits(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {k: v for k, v in got.items() if k < 100} == {k: (50, 50 + k) for k in (14, 25, 40)} and 100 in got
    text = "of the one and of the one and of rare1 rare2 the one of the and rare3 of the one"
    items = decontamination.Items([(1, text)], 3, {"of": 9000, "the": 9500, "one": 8000, "and": 9000})
    words_ = text.split()
    chosen = [" ".join(words_[p : p + 3]) for p in items.place.tolist()]
    # Of each four the two with the rarest words, whatever the others are like.
    assert [sum(p // 4 == k for p in items.place.tolist()) for k in range(5)] == [2, 2, 2, 2, 2]
    assert "of rare1 rare2" in chosen and "rare1 rare2 the" in chosen and "rare3 of the" in chosen


def test_line_dedup_under_a_hot_head(spark):
    """600 lines of 15 words begin with the same ten; 150 of them are copies of others with three words edited."""
    rnd = random.Random(51)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))
    head, lines = [word() for _ in range(10)], []
    for _ in range(150):
        tail = [word() for _ in range(5)]
        lines.append((head + tail, False))
        edited = list(tail)
        for j in rnd.sample(range(5), 3):
            edited[j] = word()
        lines.append((head + edited, True))
    lines += [(head + [word() for _ in range(5)], False) for _ in range(300)]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, (w, _) in enumerate(lines)], "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["_sl_removed"] for r in line_dedup.dedup(docs, full=True).collect()}
    assert {i for i, n in got.items() if n} == {i for i, (_, copy) in enumerate(lines) if copy}


def test_full_line_dedup_with_edits_in_every_fifth_word(spark):
    """400 lines of 40 words, each with a copy of which every fifth word differs: few of its word grams are left."""
    rnd = random.Random(52)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    lines = []
    for _ in range(400):
        line = [word() for _ in range(40)]
        lines += [line, [word() if j % 5 == 4 else w for j, w in enumerate(line)]]
    assert full_removed(spark, [" ".join(w) for w in lines]) == [0, 1] * 400


def test_full_line_dedup_where_all_words_are_hot(spark):
    """600 lines of 20 words with one head; over 64 lines share each word of their tails, too. Against all pairs."""
    rnd = random.Random(53)
    head, vocab = [f"head{c}" for c in "abcdefghijkl"], ["".join(rnd.choice("bcdfgklmnprst") + rnd.choice("aeiou") for _ in range(3)) for _ in range(40)]
    tails = []
    for _ in range(300):
        tail = rnd.choices(vocab, k=8)
        tails.append(tail)
        tails.append([rnd.choice(vocab) if j in (1, 3, 4, 6) else w for j, w in enumerate(tail)])
    rnd.shuffle(tails)
    root = list(range(len(tails)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(tails):
        for j, y in enumerate(tails[:i]):
            if (Counter(x) - Counter(y)).total() <= 4 and edits(x, y) <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    kept, want = set(), []
    for i in range(len(tails)):
        want.append(int(find(i) in kept))
        kept.add(find(i))
    got = full_removed(spark, [" ".join(head + t) for t in tails])
    assert 250 < sum(want) < 500 and got == want


def test_ball_links_of_fingerprints_that_begin_alike(spark):
    """All in one prefix: with few variants in memory at once the same are connected as by all pairs."""
    rnd = random.Random(54)
    fps = {rnd.getrandbits(24) for _ in range(60)}
    fps |= {x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(30)) ^ (1 << rnd.randrange(30)) for x in list(fps) for _ in range(2)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x),) for x in sorted(fps)], "fp long")
    got = components(simhash_balls.links(df, len(fps), held=3000)).collect()
    groups = defaultdict(set)
    for r in got:
        groups[r["root"]].add(r["node"])
    want, left = set(), set(fps)
    while left:
        part, new = set(), {left.pop()}
        while new:
            part |= new
            new = {y for y in left if any((x ^ y).bit_count() <= 4 for x in new)}
            left -= new
        if len(part) > 1:
            want.add(frozenset(map(signed, part)))
    assert len(want) > 10 and {frozenset(g) for g in groups.values()} == want


def test_written_leaves_no_shuffle_files(spark):
    """Else they stay until the driver collects its garbage; the session's own setting stays."""
    shuffles = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ").split() if "shuffle_" in f}
    before, said = shuffles(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    out = written(spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n")))
    until = time.time() + 10
    while shuffles() - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffles() - before and out.count() == 700
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == said


def test_full_line_dedup_keeps_one_table(spark):
    docs = spark.createDataFrame([(i, f"one two three four five six word{i % 7}x and more") for i in range(50)], "doc_id long, text string")
    with remembered([]) as own:
        assert sum(r["_sl_removed"] for r in line_dedup.dedup(docs, full=True).collect()) > 40
    # The lines that go and the mask that finds their documents.
    assert len(own) > 10 and len([t for t in own if "_sl_path" in t.__dict__]) == 2


def test_full_line_dedup_by_blocks_and_finer_keys(spark, monkeypatch):
    """With blocks of 32 lines the hot head's pairs get finer keys, and some of these several blocks."""
    monkeypatch.setattr(line_dedup, "_BLOCK", 32)
    test_line_dedup_under_a_hot_head(spark)
    test_full_line_dedup_where_all_words_are_hot(spark)


def test_full_line_dedup_in_many_shares(spark, monkeypatch):
    """The same lines go when keys, hot keys and pairs are met in shares, and no table has the rows of all keys or pairs."""
    for name in ("_SHARE_KEYS", "_SHARE_LINES", "_SHARE_PAIRS"):
        monkeypatch.setattr(line_dedup, name, 4000)
    monkeypatch.setattr(line_dedup, "_BLOCK", 32)
    with remembered([]) as tables:
        seen, keep = [], line_dedup.discard
        monkeypatch.setattr(line_dedup, "discard", lambda *ts: (seen.extend((t.columns, t.count()) for t in ts if "_sl_path" in t.__dict__), keep(*ts)))
        test_line_dedup_under_a_hot_head(spark)
    keyed = [n for columns, n in seen if columns == ["nid", "n", "p", "q", "_sl_key", "_sl_m"]]
    assert len(keyed) > 1 and max(keyed) <= 8000
    # Keys are not kept with words, and words only once.
    assert all(not {"keys", "bits"} <= set(t.columns) and "words" not in t.columns for t in tables)


def test_bands_of_blocks(spark):
    """Nodes of many blocks: bands that no two nodes have end once for each node, not for each of its blocks."""
    r, size = random.Random(3), 2 * simhash_balls._SKETCH
    sketches = [bytes(r.randrange(256) for _ in range(size)) for _ in range(40)]
    sketches += [x[:8] + bytes(r.randrange(256) for _ in range(size - 8)) for x in sketches[:10]]
    blocks = [(b, n) for b in range(60) for n in range(50) if r.random() < 0.5]
    step = 2 * simhash_balls._BAND
    sharing = lambda a, b: sum(sketches[a][i : i + step] == sketches[b][i : i + step] for i in range(0, size, step))
    own = [{n for b, n in blocks if b == k} for k in range(60)]
    want = sorted(n for ns in own for n in ns for _ in range(max(sharing(n, m) if m != n else 0 for m in ns)))
    with remembered([]) as tables:
        got = simhash_balls._banded(spark.createDataFrame(blocks, "block long, nid long"), spark.createDataFrame(list(enumerate(map(bytearray, sketches))), "nid long, sketch binary")).collect()
    assert sorted(x["nid"] for x in got) == want
    assert max(t.count() for t in tables if t.__dict__.get("_sl_path")) < len(blocks)


def test_balls_of_texts_that_share_a_band(spark, monkeypatch):
    """Texts of a few common words have close fingerprints by chance; only those with a similar text reach the balls."""
    r, seen, links = random.Random(5), [], simhash_balls.links
    texts = [" ".join(r.choice(["of", "the", "and", "to", "in"]) if r.random() < 0.9 else "w%d" % r.randrange(10**6) for _ in range(80)) for _ in range(120)]
    docs = [(i, t) for i, t in enumerate([*texts, *(t + " end" for t in texts[:10])])]
    monkeypatch.setattr(simhash_balls, "links", lambda fps, n, *a: (seen.append(n), links(fps, n, *a))[1])
    got = simhash_balls.near_copies(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted(x["doc_id"] for x in got.collect()) == list(range(120))
    assert len(seen) == 3 and max(seen) < 60


def test_lines_are_alike_by_outlines_first(spark):
    """The same pairs as by words and letters, of which only those that outlines leave open are read."""
    r = random.Random(11)
    base = [["w%d" % r.randrange(300) for _ in range(r.randrange(6, 70))] for _ in range(60)]
    lines = base + [[w if r.random() < 0.85 else w + "x" if r.random() < 0.5 else "n%d" % r.randrange(300) for w in x] for x in base]
    bits = [[xxhash.xxh32_intdigest(w) & 0xFFFFF for w in x] for x in lines]
    df = spark.createDataFrame([(i, b, " ".join(x) if len(x) < 20 else None) for i, (b, x) in enumerate(zip(bits, lines, strict=True))], "nid long, bits array<int>, letters string")
    ids = spark.range(len(lines)).withColumnRenamed("id", "nid")
    pairs = spark.createDataFrame([(a, b) for a in range(len(lines)) for b in range(a + 1, len(lines)) if b == a + 60 or r.random() < 0.2], "a long, b long")

    def alike(a, b):
        n, e = max(len(bits[a]), len(bits[b])), edits(bits[a], bits[b])
        if e <= n // 5:
            return True
        x, y = (" ".join(lines[i]) for i in (a, b))
        return len(lines[a]) < 20 and len(lines[b]) < 20 and e <= max(0.2 * n, min(4, 0.4 * n)) + 1e-9 and edits(x, y) <= max(len(x), len(y)) // 5

    want = sorted((x["a"], x["b"]) for x in pairs.collect() if alike(x["a"], x["b"]))
    with remembered([]) as tables:
        texts = line_dedup._texts(df, ids)
        got = sorted((x["a"], x["b"]) for x in line_dedup._alike(pairs, texts, 0.8, pairs.count()).collect())
    assert got == want and 20 < len(want) < 60
    open_ones = [t for t in tables if t.columns == ["a", "b"]]
    assert len(open_ones) == 1 and open_ones[0].count() <= 60
    assert all(len(x["outline"]) == len(bits[x["nid"]]) for x in texts.collect())


def test_words_are_merged_once():
    """A word with a mark, or on a line of its own, takes the ids of the word; results are the library's."""
    from speechlake.llm.tokens import Encoder

    r = random.Random(9)
    words = ["wort", "Wort", "ärger", "don't", "a1", "x.", "<|endoftext|>", "漢", "!!", "'s"]
    odd = ["".join(r.choice([*words, " ", " ", "\n", ".", ",", "?", "\t"]) for _ in range(r.randrange(12))) for _ in range(3000)]
    for name, kind in (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")):
        e, asked = Encoder(vocabulary(name), kind), Counter()
        tokenize = e.tokenize
        e.tokenize = lambda x, tokenize=tokenize, asked=asked: (asked.update([x]), tokenize(x))[1]
        e.ids_of(["a wort wort, wort. wort; a\nwort! b\nwort wort?\nb"])
        assert max(n for x, n in asked.items() if "wort" in x) == 1 and sum("wort" in x for x in asked) <= 2
        assert e.ids_of(odd) == [np.array(x.ids, dtype="<u4").tobytes() for x in e.tokenizer.encode_batch(odd, add_special_tokens=False)]
