"""Single operators on literals, and parallel forms against sequential ones."""

from __future__ import annotations

import io
import random
import wave

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from speechlake.catalog import ORACLES, QUERIES
from speechlake.functions import text as T
from speechlake.functions import vectorized as V
from speechlake.functions import vectors as X
from speechlake.operators import aggregate, audio, batching, control, corpus, evaluation, packages
from speechlake.sources import readers
from speechlake.tables import numbered, scratch


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column.alias("x")).first()["x"]


def test_ngram_jaccard_third(spark):
    items = spark.createDataFrame([(1, "アイウエ"), (2, "x")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "アイウオ"), (2, "?!")], "doc_id long, text string")
    got = {r["item_id"]: r for r in evaluation.leakage(items, docs, 3, 0.6).collect()}
    assert got[1]["max_jaccard"] == pytest.approx(1 / 3, abs=1e-6) and not got[1]["leaked"]
    assert got[2]["max_jaccard"] == 1.0 and got[2]["leaked"]  # both have no 3-gram


def test_repeats():
    assert V.repeats("abababababababababababab", 2, 10) and not V.repeats("abababababababababab", 2, 10)
    assert not V.repeats("", 2, 10) and not V.repeats(None, 2, 0)


def test_repeats_against_counting():
    from collections import Counter

    rnd = random.Random(6)
    for length in (1, 2, 3, 4, 6):
        for _ in range(40):
            text = "".join(rnd.choice("abé😀") for _ in range(rnd.choice([0, 3, 50, 9000]))) if rnd.random() < 0.7 else "".join(map(chr, rnd.choices(range(97, 9000), k=6000)))
            most = max(Counter(text[i : i + length] for i in range(len(text) - length + 1)).values(), default=0)
            for tolerance in (0, most - 1, most):
                assert V.repeats(text, length, tolerance) == (most > tolerance) or tolerance < 0


def test_error_rates(spark):
    assert one(spark, T.error_rate(F.col("a"), F.col("b")), a="東京", b="東") == 0.5
    assert one(spark, T.error_rate(F.col("a"), F.col("b")), a="", b="x") == 1.0
    assert spark.range(1).select(T.word_error_rate(F.lit("a b c d"), F.lit("a x c")).alias("x")).first()["x"] == 0.5


def test_word_error_rate_random(spark):
    """Against the whole table of distances."""
    rnd = random.Random(3)
    rows = [(i, " ".join(rnd.choice("a b c dd é".split()) for _ in range(rnd.randrange(9))), rnd.choice([" ", "  ", "\n"]).join(rnd.choice("a b c dd é".split()) for _ in range(rnd.randrange(9)))) for i in range(200)] + [(200, None, "a"), (201, "a b", None), (202, " x ", "x")]
    got = {r["i"]: r["w"] for r in spark.createDataFrame(rows, "i long, a string, b string").select("i", T.word_error_rate(F.col("a"), F.col("b")).alias("w")).collect()}
    for i, t, h in rows:
        a, b = (t or "").split(), (h or "").split()
        row = list(range(len(b) + 1))
        for x in a:
            last, row[0] = row[0], row[0] + 1
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert got[i] == (row[-1] / len(a) if a else None)


def test_wer_form(spark):
    assert one(spark, T.wer_form(F.col("a"), "zh"), a="你，好") == "你 好"
    assert one(spark, T.wer_form(F.col("a"), "en"), a="It's  OK.") == "its ok"


def test_clean_up(spark):
    assert one(spark, T.clean_ja(F.col("a")), a="あ　 い") == "あ い。"
    assert one(spark, T.clean_ja(F.col("a")), a="「あ」") == "「あ」"
    assert one(spark, T.clean_cn(F.col("a")), a=" 你 好？ ") == "你好？"
    assert one(spark, T.clean_cn(F.col("a")), a="  ") == ""


def test_japanese():
    assert V.normal_ja("Ａ〜  「い」.") == ("Aー い。", V.normal_ja("Ａ〜  「い」.")[1])
    assert V.normal_ja("a�")[0] is None


def test_portable_key_join(spark):
    a = spark.createDataFrame([("冒険者Ａ/m_adva0001.ogg",), ("only/here.ogg",)], "p string")
    b = spark.createDataFrame([("冒険者ａ/m_adva0001.ogg",), ("only/there.ogg",)], "p string")
    got = {r["verdict"]: (r["path"], r["indexed_as"]) for r in packages.by_portable_key(a, b, "p", V.portable_key).collect()}
    assert got["matched"] == ("冒険者ａ/m_adva0001.ogg", "冒険者Ａ/m_adva0001.ogg")
    assert got["missing"][0] == "only/here.ogg" and got["unindexed"][0] == "only/there.ogg"


def test_oov(spark):
    rows = spark.createDataFrame([(1, "ワタシ☆")], "i long, text string")
    vocab = spark.createDataFrame([("ワ", 0), ("タ", 1), ("シ", 2)], "token string, idx long")
    assert [r["token"] for r in corpus.out_of_vocabulary(rows, vocab, "i").collect()] == ["☆"]


def test_chunks():
    text = "One two, three. Four five! 六七。八九"
    assert "".join(V.chunks(text, 12)).replace(" ", "") == text.replace(" ", "")
    assert all(len(c.encode()) <= 12 or c in text for c in V.chunks(text, 12))


def test_mixed_tokens():
    assert V.mixed_tokens("hi 你 go", {"你": "ni3"}) == ["h", "i", " ", " ", "ni3", " ", "g", "o"]


def test_times(spark):
    assert one(spark, T.seconds_of(F.col("a")), a="01:02:03") == 3723
    assert one(spark, T.seconds_of(F.col("a")), a="01:60:03") is None


def greedy_sum(lengths, budget, most, drop):
    batches, batch, used = [], [], 0
    for i, x in sorted(enumerate(lengths), key=lambda p: (p[1], p[0])):
        if used + x <= budget and (most == 0 or len(batch) < most):
            batch.append(i)
            used += x
        else:
            if batch:
                batches.append(batch)
            batch, used = ([i], x) if x <= budget else ([], 0)
    return batches + ([batch] if batch and not drop else [])


def greedy_padded(lengths, budget, most):
    batches, batch = [], []
    for i, x in sorted(((i, x) for i, x in enumerate(lengths) if x <= budget), key=lambda p: (p[1], p[0])):
        if batch and (x * (len(batch) + 1) > budget or most and len(batch) + 1 > most):
            batches.append(batch)
            batch = []
        batch.append(i)
    return batches + ([batch] if batch else [])


def planned(runs, lengths):
    places, out = {}, {}
    for i, x in sorted(enumerate(lengths), key=lambda p: (p[1], p[0])):
        rank = places.get(x, 0)
        places[x] = rank + 1
        for r in runs:
            if r.length == x and r.lo <= rank < r.hi:
                out.setdefault(r.first + (rank - r.lo) // r.size, []).append(i)
    return [out[k] for k in sorted(out)]


def test_batch_plans_equal_the_sequential_rule():
    rnd = random.Random(2)
    for _ in range(2000):
        lengths = [rnd.randint(1, 12) for _ in range(rnd.randint(0, 30))]
        budget, most, drop = rnd.randint(1, 30), rnd.choice([0, 0, 1, 2, 5]), rnd.random() < 0.3
        histogram = sorted({x: lengths.count(x) for x in lengths if x <= budget}.items())
        assert planned(batching.sum_runs(histogram, budget, most, drop, any(x > budget for x in lengths)), lengths) == greedy_sum(lengths, budget, most, drop)
        assert planned(batching.padded_runs(histogram, budget, most), lengths) == greedy_padded(lengths, budget, most)


def test_holdout_equals_the_sequential_rule(spark):
    rnd = random.Random(3)
    for _ in range(5):
        rows = [(f"s{rnd.randint(0, 6)}", f"{rnd.getrandbits(40):010x}") for _ in range(rnd.randint(1, 40))]
        k, left, taken = rnd.randint(0, 12), {}, set()
        for s, _ in rows:
            left[s] = left.get(s, 0) + 1
        for s, r in sorted(rows, key=lambda x: x[1]):
            if len(taken) < k and left[s] > 1:
                taken.add(r)
                left[s] -= 1
        got = aggregate.holdout(spark.createDataFrame(rows, "speaker string, rank string"), "speaker", "rank", k)
        assert {r["rank"] for r in got.where("split = 'eval'").collect()} == taken


def test_conflicts_and_winners(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("b", "y", 3)], "audio_sha256 string, text string, o long")
    assert [tuple(r) for r in aggregate.aggregated(rows, ["o"]).collect()] == [("a", "x", 1)]
    assert {(r["audio_sha256"], r["o"], r["winner"]["o"]) for r in aggregate.duplicates(rows, ["audio_sha256", "text"], ["o"]).collect()} == {("a", 2, 1), ("b", 3, 2)}
    assert [(r["audio_sha256"], r["texts"]) for r in aggregate.conflicts(rows).collect()] == [("b", ["x", "y"])]


def test_numbers_do_not_depend_on_partitions(spark):
    rows = spark.range(500).select(F.col("id"), F.pmod(F.xxhash64("id"), F.lit(97)).alias("k"))
    for n in (1, 7):
        got = numbered(rows.repartition(n), ["k", "id"], "at").orderBy("at").collect()
        assert [r["at"] for r in got] == list(range(500)) and [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_gates_and_verdicts(spark):
    row = spark.createDataFrame([(24000, None)], "rate int, clip double")
    assert row.select(evaluation.gate_failures({"sample_rate": F.col("rate") == 24000, "clipping": F.col("clip") <= 0.1}).alias("f")).first()["f"] == ["clipping"]
    s = spark.createDataFrame([(1, 0.1), (2, None), (3, 0.3)], "i long, m double")
    got = {r["i"]: r["verdict"] for r in evaluation.verdicts(s, F.col("i") == 1, {"ok": ("m", "<=", 0.05)}).collect()}
    assert got == {1: True, 2: None, 3: False}


def test_resume_takes_the_last_record(spark):
    log = spark.createDataFrame([("a", 1, "ok"), ("a", 2, "error"), ("b", 1, "error"), ("b", 2, "ok")], "job string, o long, status string").withColumn("at", F.col("o"))
    jobs = spark.createDataFrame([("a",), ("b",), ("c",)], "job string")
    assert {r["job"] for r in evaluation.unfinished(jobs, log, "job", "at", F.col("status") == "ok").collect()} == {"a", "c"}


def test_blind_order():
    items = [(f"{s}__{t}", s, t) for s in "abc" for t in "wxyz"]
    order = evaluation.blind_order(items, "k")
    assert sorted(order) == list(range(12)) and order == evaluation.blind_order(items, "k")
    assert sum(items[a][2] == items[b][2] for a, b in zip(order, order[1:], strict=False)) <= 1


def test_chain_audit(spark):
    log = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (1, 3, "A")], "item long, o long, state string")
    legal = spark.createDataFrame([("A", "B")], "state string, next_state string")
    assert [(r["state"], r["next_state"]) for r in control.chain_audit(log, "item", "o", "state", legal).collect()] == [("B", "A")]


def test_leases(spark, tmp_path):
    from speechlake.streaming import jobs

    log = spark.createDataFrame([(1, 1, "one", 100.0), (1, 2, "two", 101.0), (1, 3, "two", 161.0), (1, 4, "one", 162.0)], "item long, o long, owner string, at double")
    log.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = jobs.stream_of(spark, f"{tmp_path}/in", log.schema)
    out = jobs.arbitrate_leases(stream, "item", "o", "owner", "at", 60.0)
    assert {r["o"]: r["granted"] for r in jobs.finished(out, "append").collect()} == {1: True, 2: False, 3: True, 4: False}
    for ttl in (59.0, 7 * 86400.5):
        with pytest.raises(ValueError, match="lease"):
            jobs.arbitrate_leases(stream, "item", "o", "owner", "at", ttl)


def test_lease_ends_by_its_timer(spark, tmp_path):
    """One item has a third of all requests, in several frames of a batch; a lease that the watermark passes is gone."""
    from datetime import datetime, timedelta

    from speechlake.streaming import jobs

    start = datetime(2024, 1, 1)
    rows = [(0 if i % 3 == 0 else i, i, f"o{i % 5}", float(i), start + timedelta(seconds=i)) for i in range(3000)]
    rows += [(0, 5000, "late", 90_000.0, start + timedelta(days=2)), (0, 6000, "later", 90_030.0, start + timedelta(days=2, seconds=30))]
    for part in range(3):
        some = [r for r in rows if r[1] // 2500 == part]
        spark.createDataFrame(some, "item long, o long, owner string, at double, ts timestamp").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    stream = jobs.stream_of(spark, f"{tmp_path}/in", "item long, o long, owner string, at double, ts timestamp", 2).withWatermark("ts", "1 minute")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = {r["o"]: r["granted"] for r in jobs.finished(jobs.arbitrate_leases(stream, "item", "o", "owner", "at", 60.0, "ts"), "append").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {}, {}
    for item, o, owner, at, _ in rows:
        holder, expires = held.get(item, (None, -1.0))
        want[o] = holder in (None, owner) or expires <= at
        if want[o]:
            held[item] = (owner, at + 60.0)
    assert got == want


def test_chain_validator_hot_item(spark, tmp_path):
    from speechlake.streaming import jobs

    rows = [(0 if i % 3 == 0 else i % 50, i, "ABC"[(i * 7 // 3) % 3]) for i in range(3000)]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 1000 == part], "item long, o long, state string").repartition(2).write.mode("append").parquet(f"{tmp_path}/in")
    out = jobs.validate_chains(jobs.stream_of(spark, f"{tmp_path}/in", "item long, o long, state string", 2), "item", "o", "state", {("A", "B"), ("B", "C")}, {"A"})
    got = {r["item"]: tuple(r)[1:] for r in jobs.finished(out, "update", ["item"]).collect()}
    want = {}
    for item, _, state in rows:
        steps, illegal, attempts, last = want.get(item, (-1, 0, 0, None))
        want[item] = (steps + 1, illegal + (last is not None and (last, state) not in {("A", "B"), ("B", "C")}), attempts + (state == "A"), state)
    assert got == want


@pytest.mark.parametrize("crowd", [1, 7, 4096])
def test_quantiles_by_radix_selection(spark, crowd):
    import math
    import random

    from speechlake.operators.quantiles import Quantile, quantiles

    r = random.Random(crowd)
    kinds = [lambda: r.gauss(0, 1), lambda: 10 ** r.uniform(-300, 300) * r.choice([-1, 1]), lambda: float(r.randrange(3)), lambda: 1.0 + r.random() * 1e-12, lambda: r.choice([0.0, -0.0, None, float("inf"), float("-inf"), 5e-324])]
    rows = [(g, kinds[k % 5](), r.random() < 0.3) for k, g in enumerate([None, "a", "b", "c", "d"]) for _ in range(400)] + [("e", None, True), ("f", 2.5, True)]
    df = spark.createDataFrame(rows, "g string, v double, own boolean").repartition(4)
    fractions = (0.0, 0.1, 0.5, 0.9, 1.0)
    picks = {f"n{i}": Quantile("v", f) for i, f in enumerate(fractions)} | {f"c{i}": Quantile("v", f, where=F.col("own")) for i, f in enumerate(fractions)} | {"mid": Quantile("v", 0.37, linear=True)}
    got = {x["g"]: x for x in quantiles(df, ["g"], picks, crowd).collect()}
    assert set(got) == {None, "a", "b", "c", "d", "f"}
    for g, row in got.items():
        for prefix, values in (("n", sorted(v for k, v, _ in rows if k == g and v is not None)), ("c", sorted(v for k, v, own in rows if k == g and own and v is not None))):
            assert [row[f"{prefix}{i}"] for i in range(5)] == [values[round((len(values) - 1) * f)] for f in fractions]
        values = sorted(v for k, v, _ in rows if k == g and v is not None)
        at = (len(values) - 1) * 0.37
        a, b = values[math.floor(at)], values[math.ceil(at)]
        want = a * (1 - (at - math.floor(at))) + b * (at - math.floor(at))
        assert row["mid"] == want or math.isclose(row["mid"], want) or math.isnan(want)


def test_manifest_reader(spark, tmp_path):
    (tmp_path / "m.csv").write_text("﻿audio_file|text\n/a.wav| hi | there \nb.wav|x\n\n/c.wav\n", encoding="utf-8")
    got = {r["line"]: (r["audio_file"], r["text"], r["reason"]) for r in readers.piped_manifest(spark, str(tmp_path)).collect()}
    assert got == {2: ("/a.wav", "hi | there", None), 3: ("b.wav", "x", "relative_path"), 5: ("/c.wav", None, "malformed")}


def test_sidecars_and_lists(spark, tmp_path):
    (tmp_path / "u1.normalized.txt").write_text(" hello\n")
    assert [tuple(r) for r in readers.sidecars(spark, str(tmp_path), ".normalized.txt").collect()] == [("u1", "hello")]
    (tmp_path / "e.lst").write_text("1-2-3\t1.5\tA b.\t4-5-6\t2.0\tC d.\n")
    r = readers.tabbed_eval_list(spark, str(tmp_path / "e.lst"), "/x").first()
    assert r["ref_wav"] == "/x/1/2/1-2-3.flac" and r["gen_wav"] == "/x/4/5/4-5-6.flac"


def test_wav_reader(spark, tmp_path):
    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(8000)
        w.writeframes(np.zeros(1600, dtype="<i2").tobytes())
    (tmp_path / "b.wav").write_bytes(b"not audio")
    got = {r["path"][-5:]: r for r in readers.wav_files(spark, str(tmp_path)).collect()}
    assert got["a.wav"]["duration"] == 0.1 and got["a.wav"]["channels"] == 2 and not got["b.wav"]["ok"]
    assert audio.read_wav(io.BytesIO(b"").getvalue()) is None


def test_signal_helpers():
    t = np.arange(2400) / 2400
    tone = np.sin(2 * np.pi * 50 * t)
    up = audio.resample(tone, 2400, 4800)
    assert len(up) == 4800 and np.abs(up[400:4400] - np.sin(2 * np.pi * 50 * np.arange(4800) / 4800)[400:4400]).max() < 0.01
    quiet = np.concatenate([tone, np.zeros(4800), tone])
    out, cut = audio.trimmed(quiet, 2400)
    assert cut > 1 and len(out) + round(cut * 2400) == len(quiet)
    assert audio.trimmed(np.zeros(100), 2400)[1] == 0.0
    assert len(audio.slices(quiet, 2400, min_length=0.2, max_silence=0.1)) == 2
    assert audio.log_mel(tone, 2400, 256, 64, 20).shape[0] == 20
    assert len(audio.crossfade([tone, tone], 2400, 0.1)) == 2 * 2400 - 240
    path = audio.dtw(np.eye(4), np.eye(4))
    assert path == [(i, i) for i in range(4)]
    a, b = audio.aligned(np.eye(4), np.eye(4)[[0, 0, 1, 2, 3]], 0.5)
    assert a.shape == b.shape
    assert audio.edit_mask([(0.0, 1.0)], [0.5], 2.0, 100, 1) == [False] * 50 + [True] * 100


def test_blends_and_curves(spark):
    r = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0])], "a array<double>, b array<double>")
    got = r.select(X.slerp(F.col("a"), F.col("b"), 0.5).alias("s"), X.log_blend(F.col("a"), F.col("b"), 0.5).alias("l")).first()
    assert got["s"] == pytest.approx([1.5 / 2**0.5] * 2)
    g = spark.createDataFrame([(0.0, 0), (1.0, 2)], "t double, f int").select(X.grid_weight([[0.0, 1.0], [1.0, 0.0]], F.col("t"), F.col("f"), F.lit(3)).alias("w")).collect()
    assert [x["w"] for x in g] == pytest.approx([0.0, 0.0])


def test_udtf(spark):
    from speechlake.functions import udf

    udf.register(spark)
    rows = spark.sql("SELECT s.chunk, s.text FROM (SELECT 'One two. Three four.' AS t) x, LATERAL sentence_chunks(x.t, 10) s").collect()
    assert [(r["chunk"], r["text"]) for r in rows] == [(0, "One two."), (1, "Three four.")]


def test_shards_are_written_once(spark):
    from speechlake.sources import sinks

    path = scratch(spark)
    rows = spark.range(250).select("id")
    assert {(r["shard_id"], r["n_rows"]) for r in sinks.write_shards(rows, path, ["id"], 100).collect()} == {(0, 100), (1, 100), (2, 50)}
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_shards(rows, path, ["id"], 100)


def test_japanese_events():
    text, events = V.normal_ja(" 〜「あ」   x ")
    assert text == "ーあ  x"
    assert [e[0] for e in events] == ["map"] * 8 + ["trim"] * 2 and events[0] == ("map", 0, " ", " ", "whitespace")
    assert [(p, to) for _, p, c, to, _ in events if c == " " and _ == "whitespace"][1:5] == [(5, " "), (6, ""), (7, " "), (9, " ")]
    assert V.normal_ja("a�b�")[1] == [("reject", 1, "�", "", "replacement_character"), ("reject", 3, "�", "", "replacement_character")]
    assert V.normal_ja("ｶﾞ")[1][0] == ("normalize", 0, "ｶﾞ", "ガ", "nfkc")


def test_chunks_are_greedy():
    """Against packing sentence by sentence."""
    import random

    rnd = random.Random(1)
    for _ in range(200):
        parts = ["".join(rnd.choices("ab é", k=rnd.randint(1, 9))).strip() + rnd.choice([". ", "! ", "。", "，", "; "]) for _ in range(rnd.randint(0, 12))]
        text, most = "".join(parts), rnd.randint(3, 30)
        want, now = [], ""
        for s in V.sentences(text):
            if now and len(now.encode()) + len(s.encode()) > most:
                want.append(now.strip())
                now = ""
            now += s + (" " if s[-1].isascii() else "")
        assert V.chunks(text, most) == want + ([now.strip()] if now else [])


def test_dtw_by_cells():
    rnd = np.random.default_rng(5)
    a, b = rnd.random((7, 3)), rnd.random((9, 3))
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    cost = 1 - unit(a) @ unit(b).T
    total = np.full((8, 10), np.inf)
    total[0, 0] = 0
    for i in range(7):
        for j in range(9):
            total[i + 1, j + 1] = cost[i, j] + min(total[i, j], total[i, j + 1], total[i + 1, j])
    path = audio.dtw(a, b)
    assert path[0] == (0, 0) and path[-1] == (6, 8) and sum(cost[p] for p in path) == pytest.approx(total[7, 9])
    x, y = audio.aligned(a[:1], b, 0.5)
    assert x.shape == y.shape == (5, 3)


def test_fade_values_and_mel_of_a_tone():
    one, two = np.ones(10), np.full(10, 3.0)
    out = audio.crossfade([one, two], 10, 0.4)
    assert out.tolist() == pytest.approx([1] * 6 + [1, 1 + 2 / 3, 1 + 4 / 3, 3] + [3] * 6)
    tone = np.sin(2 * np.pi * 600 * np.arange(4800) / 4800)
    mel = audio.log_mel(tone, 4800, 256, 64, 20)
    top = int(mel.mean(axis=1).argmax())
    bins = np.linspace(0, 2400, 129)
    assert audio.mel_bank(4800, 256, 20)[top][np.abs(bins - 600).argmin()] > 0
    assert audio.quality is not None and audio.read_wav(audio.write_wav(tone, 4800))[0][0] == pytest.approx(tone, abs=1e-4)


def test_catalog_faults(spark, tmp_path):
    (tmp_path / "c.md").write_text("# One\n| id | name |\n|---|---|\n| A | x |\n| a | y |\n| b |\n## Two\n| B\\|C | z |\n")
    rows = {r["line"]: (r["section"], r["id"], r["reason"]) for r in readers.catalog(spark, str(tmp_path / "c.md"), ["id", "name"]).collect()}
    assert rows == {4: ("One", "A", None), 5: ("One", "a", "duplicate_key"), 6: ("One", "b", "malformed"), 8: ("Two", "B|C", None)}


def test_line_numbers_over_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(4000)]
    (tmp_path / "big.txt").write_text("\n".join(lines))
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = {r["line"]: r["value"] for r in readers.numbered_lines(spark, str(tmp_path / "big.txt")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == {i + 1: x for i, x in enumerate(lines)}


def test_pareto_with_gaps(spark):
    rows = [(1, 1.0, 5.0), (2, 2.0, 5.0), (3, None, 9.0), (4, 0.5, 1.0), (5, 3.0, None), (6, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "k long, lo double, hi double").repartition(3)

    def beats(b, a):
        pairs = [(x, y, up) for x, y, up in ((b[1], a[1], False), (b[2], a[2], True)) if x is not None and y is not None]
        return bool(pairs) and all(x >= y if up else x <= y for x, y, up in pairs) and any(x > y if up else x < y for x, y, up in pairs)

    want = {a[0] for a in rows if not any(beats(b, a) for b in rows if b[0] != a[0])}
    assert {r["k"] for r in evaluation.pareto(df, "k", ["lo"], ["hi"]).collect()} == want


def test_longer_tokens_and_attempts(spark):
    rows = spark.createDataFrame([(1, ["a", "ni3", "?", "é"])], "i long, t array<string>")
    vocab = spark.createDataFrame([(" ", 0), ("a", 1), ("é", 2), ("ni3", 3)], "token string, idx long")
    assert corpus.token_ids(F.col("t"), vocab, rows).first()["ids"] == [1, 3, 0, 2]
    log = spark.createDataFrame([("x", "S"), ("x", "S"), ("x", "E")], "item string, state string")
    assert control.attempts(log, "item", "state", ["S"]).first()["attempts"] == 2


def test_mono(spark):
    from speechlake.functions import vectors

    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "c array<array<double>>")
    assert df.select(vectors.mono(F.col("c")).alias("m")).first()["m"] == [2.0, 4.0]


def test_discard(spark):
    from speechlake.tables import discard, remembered, written

    kept = []
    with remembered(kept):
        a = written(spark.range(3))
    discard(spark.range(2))
    assert kept == [a] and a.count() == 3
    path = a._sl_path.removeprefix("file://")
    discard(a)
    assert not __import__("os").path.exists(path)


def _numbers(spark, n, change=None):
    return spark.range(n).select("id", F.when(F.col("id") == (-1 if change is None else change), "other").otherwise("same").alias("v"))


def test_publish_once_or_not_at_all(spark, tmp_path, monkeypatch):
    from speechlake.sources import sinks

    path, rows = f"file://{tmp_path}/out", _numbers(spark, 95)
    with pytest.raises(FileNotFoundError):
        sinks.published(spark, path)
    real = sinks.Store.move

    def crash(self, name, to):
        if to == fatal[0]:
            raise InterruptedError
        return real(self, name, to)

    monkeypatch.setattr(sinks.Store, "move", crash)
    store = sinks.Store(spark, path)
    # Before the folder has its name, and after that but before the marker: nothing is published, the next run clears up.
    for fatal in (["nothing"], [sinks.MARKER]):
        if fatal == ["nothing"]:
            fatal[0] = sinks.DATA + aggregate.root_digest(sinks._manifest(aggregate.shards(rows, ["id"], 10), rows.columns))
        with pytest.raises(InterruptedError):
            sinks.publish(rows, path, ["id"], 10)
        assert store.names()
        with pytest.raises(FileNotFoundError):
            sinks.published(spark, path)
    fatal = ["none"]
    first = sorted(map(tuple, sinks.publish(rows, path, ["id"], 10).collect()))
    assert [r[0] for r in first] == list(range(10)) and [r[1] for r in first] == [10] * 9 + [5] and len({r[3] for r in first}) == 10
    names, files = store.names(), sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    assert len(names) == 2
    # After the marker: a rerun writes nothing, other rows are refused, what is there stays.
    fatal = [sinks.MARKER]
    assert sorted(map(tuple, sinks.publish(rows.repartition(7), path, ["id"], 10).collect())) == first
    with pytest.raises(FileExistsError):
        sinks.publish(_numbers(spark, 95, 3), path, ["id"], 10)
    assert store.names() == names and files == sorted(p.name for p in (tmp_path / "out").rglob("*.parquet"))
    assert sorted(r["id"] for r in sinks.published(spark, path)[0].collect()) == list(range(95))
    fatal = ["none"]
    assert sinks.publish(rows.limit(0), f"{path}0", ["id"], 10).count() == 0


def test_merkle_names_the_first_difference(spark):
    from speechlake.sources.sinks import _manifest

    tree = lambda n, change=None: aggregate.merkle(_manifest(aggregate.shards(_numbers(spark, n, change), ["id"], 2), ["id", "v"]), 3).cache()
    one = tree(100)
    assert [one.where(F.col("level") == k).count() for k in range(5)] == [50, 17, 6, 2, 1]
    assert one.where("level = 4").first()["n_rows"] == 100
    assert aggregate.first_difference(one, tree(100), 3) is None
    for change in (0, 37, 99):
        assert aggregate.first_difference(one, tree(100, change), 3) == change // 2
    assert aggregate.first_difference(one, tree(90), 3) == 45
    assert aggregate.first_difference(one, tree(10), 3) == 5
    assert aggregate.first_difference(tree(0), tree(0), 3) is None


def test_pareto_of_random_rows_with_nulls(spark, monkeypatch):
    """A third of all metrics are null; skylines are merged in several rounds."""
    monkeypatch.setattr(evaluation, "_MERGED", 10)
    rnd = random.Random(9)
    value = lambda: None if rnd.random() < 0.3 else float(rnd.randrange(12))
    rows = [(k, value(), value(), value()) for k in range(400)] + [(400, 1.0, 11.0, 0.0), (401, 1.0, 11.0, 0.0)]
    df = spark.createDataFrame(rows, "k long, a double, up double, c double").withColumn("name", F.lit("x")).repartition(5)

    def beats(b, a):
        pairs = [(-x if i == 1 else x, -y if i == 1 else y) for i, (x, y) in enumerate(zip(b[1:], a[1:], strict=True)) if x is not None and y is not None]
        return bool(pairs) and all(x <= y for x, y in pairs) and any(x < y for x, y in pairs)

    want = {a[0] for a in rows if not any(beats(b, a) for b in rows)}
    found = evaluation.pareto(df, "k", ["a", "c"], ["up"])
    assert found.columns == df.columns and {r["k"] for r in found.collect()} == want and want
    assert "NestedLoop" not in found._jdf.queryExecution().toString()


def test_case_folding_is_full(spark):
    texts = ["ſtraße", "ΣΊΣΥΦΟΣ ς", "ﬁne ﬂow ﬀ", "ŉ ǰ ΐ", "İstanbul", "plain Ä", "ẞ", ""]
    got = [r["x"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(T.folded(F.col("t")).alias("x")).collect()]
    assert got == [t.casefold() for t in texts]


def test_bad_log_lines_by_number(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\n{"a": 2\nnothing\n{"a": "no number"}\n{"b": null, "c": 5}\n')
    log = readers.checked_log(spark, str(tmp_path / "log.jsonl"), "a long, b string")
    assert [(r["line"], r["a"], r["b"], r["reason"]) for r in log.orderBy("line").collect()][::4] == [(1, 1, "x", None), (6, None, None, None)]
    assert [r["line"] for r in log.where("reason = 'malformed'").orderBy("line").collect()] == [3, 4, 5]
    with pytest.raises(ValueError, match="line 3"):
        readers.checked(log)
    assert readers.checked(log.where("reason is null")).columns == ["a", "b"]


def test_catalog_keys_fold_forms_and_case(spark, tmp_path):
    (tmp_path / "c.md").write_text("# s\n| id | name |\n|---|---|\n| ＡＢ | x |\n| ab | y |\n| ß | z |\n| SS | z |\n| c | z |\n", encoding="utf-8")
    rows = readers.catalog(spark, str(tmp_path / "c.md"), ["id", "name"]).orderBy("line").collect()
    assert [(r["id"], r["reason"]) for r in rows] == [("ＡＢ", None), ("ab", "duplicate_key"), ("ß", None), ("SS", "duplicate_key"), ("c", None)]


@pytest.mark.parametrize("cells", [1, 16, 4096])
def test_dtw_in_linear_memory(monkeypatch, cells):
    """The path by divided parts is that of the whole table."""
    monkeypatch.setattr(audio, "_CELLS", cells)
    rnd = np.random.default_rng(cells)
    for n, m in ((7, 9), (40, 33), (3, 90), (90, 3), (1, 5), (5, 1), (2, 8)):
        a, b = rnd.normal(size=(n, 5)), rnd.normal(size=(m, 5))
        assert audio.dtw(a, b) == audio._whole_path(audio._unit(a), audio._unit(b))
    assert audio.dtw(np.empty((0, 3)), np.ones((2, 3))) == []


#: (text, lang); with an empty English text the vocabulary of SQL's string_split has the empty text.
ODD_TEXTS = {
    "empty_en": [("abc d", "en"), ("", "en"), ("", "de"), ("x bz", "de"), (None, "en"), (None, "de")],
    "empty_de": [("abc d", "en"), ("", "de"), ("xa", "de")],
    "no_space": [("\x00bc", "en"), ("b\x00 b\x85", "de"), ("a😀\U00020000漢", None)],
    "no_english": [("abc", "de"), ("", "fr"), ("�", None)],
    "equal_ids": [("ab", "en"), ("bb c", "en"), ("ax", "de"), ("a\tb", "de"), ("", "fr")],
}


def odd_documents(kind, tmp_path):
    """(folder with documents of the kind, DuckDB connection to it)."""
    ids = [0, 0, None, None, 1] if kind == "equal_ids" else range(len(ODD_TEXTS[kind]))
    texts, langs = zip(*ODD_TEXTS[kind], strict=True)
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string())}), tmp_path / "documents.parquet")
    return str(tmp_path), connect(str(tmp_path))


@pytest.mark.parametrize("kind", sorted(ODD_TEXTS))
def test_output_validation_of_odd_texts(spark, tmp_path, kind):
    where, con = odd_documents(kind, tmp_path)
    name = "t07_output_validation"
    assert compare(name, QUERIES[name](spark, where), con, ORACLES[name]) == ""


@pytest.mark.parametrize("kind", sorted(ODD_TEXTS))
def test_token_ids_of_odd_texts(spark, tmp_path, kind):
    where, con = odd_documents(kind, tmp_path)
    name = "t13_token_ids"
    assert compare(name, QUERIES[name](spark, where), con, ORACLES[name]) == ""


def test_japanese_rows_equal_single_texts(spark, monkeypatch):
    """Texts that are normalised together get what each gets alone, in parts of any size."""
    rnd = random.Random(7)
    texts = [None, "", " ", " \u3000\t ", "a", "�", "a�b� ", 'x " " y', ' " x', "ｶﾞ", "㌔ ﷺ", "\x00 \x1c", "〜～〰~", "a ", " b", "😀\U00020000 ,", "\u200b\ufeff", "quite plain, and long. " * 50]
    texts += ["".join(rnd.choice("ab \t\n\u3000\u2028\x85'\",.?!「」〜Ａｶﾞ漢😀�"[: rnd.choice((20, 25))]) for _ in range(rnd.randrange(12))) for _ in range(400)]
    want = [(None, []) if t is None else V.normal_ja(t) for t in texts]
    told = lambda rows: [(r["text"], [tuple(e[n] for n in ("stage", "position", "source", "target", "kind")) for e in r["events"]]) for r in rows]
    assert told(V.normal_ja_rows(texts).to_pylist()) == want
    assert V.normal_ja_rows([]).to_pylist() == []
    for most, parts in ((1, len(texts)), (1 << 19, 1)):
        monkeypatch.setattr(V, "_JA_CHARACTERS", most)
        cut = list(V._ja_parts(pa.array(texts)))
        assert [t for p in cut for t in p] == texts and (len(cut) > 300 if parts > 1 else len(cut) == 1)
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3).select("i", V.japanese("t").alias("x")).orderBy("i").collect()
    assert told([r["x"] for r in rows]) == want


def test_japanese_holds_events_of_few_texts():
    """A batch of many long texts comes out in parts of few."""
    texts = pa.array(["word, " * 2000] * 400)
    parts = list(V.japanese.func(iter([texts])))
    assert sum(map(len, parts)) == 400 and max(map(len, parts)) <= 50
