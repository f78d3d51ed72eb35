"""Quality rules with risk-controlled thresholds. DataFrame operations only.

Every document gets four scores in basis points. A rule rejects a document whose score reaches the
rule's cutoff in the document's stratum. Cutoffs come from labelled documents (the holdout; the grid
of candidate cutoffs is fixed beforehand, so no label helps to choose what is tested): along the grid
from the mildest cutoff on, a cutoff is accepted while the exact binomial test shows that the rule
rejects at most ``risk / number of rules`` of the good documents of the stratum. Testing stops at the
first failure (fixed-sequence testing), and the level is ``delta / (strata * rules)`` (Bonferroni), so
with probability 1 - delta no stratum loses more than ``risk`` of its good documents to all rules
together. A stratum with too few labels gets no cutoff and keeps everything.

Null text: no words, so the base rule fails. Null stratum: a stratum of its own. Labels that repeat:
a document is good only if all its labels are good. Documents that repeat are judged one by one. Very long
texts: counted whole, as arrays of their words. Empty tables: no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import SPACE, WORD, written

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCORES = ["symbol_bp", "repeat_bp", "dup_line_bp", "shout_bp"]
#: Candidate cutoffs in basis points, mildest first.
GRID = (9000, 8000, 7000, 6000, 5000, 4000, 3000, 2500, 2000, 1500, 1200, 1000, 800, 600, 500, 400, 300, 200, 100)


def _given(value: Column, f) -> Column:
    """f(value) with value computed once (a lambda variable is not expanded again)."""
    return F.transform(F.array(value), f)[0]


def repeated_words(words: Column, window: int = 5) -> Column:
    """How many of the words lie in a window of words that occurs twice or more in the array."""

    def covered(hashes: Column) -> Column:
        at = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

        def places(s: Column) -> Column:
            same = lambda i, j: (j >= 0) & (j < F.size(s)) & (F.get(s, i)["h"] == F.get(s, j)["h"])
            twice = F.filter(F.transform(s, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x["i"])), lambda p: p.isNotNull())
            return F.sort_array(twice)

        step = lambda acc, p: F.struct((acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n"), p.alias("last"))
        count = lambda ps: F.aggregate(ps, F.struct(F.lit(0).alias("n"), F.lit(-window).alias("last")), step, lambda acc: acc["n"])
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_given(F.sort_array(at), lambda s: _given(places(s), count)))

    def windows(h: Column) -> Column:
        n = F.size(h) - window + 1
        return F.when(n < 2, F.lit(0)).otherwise(_given(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(window)])), covered))

    return _given(F.transform(words, lambda w: F.xxhash64(w)), windows).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts and two more (lines with a word, letters A-Z); no shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    gone = lambda pattern: (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    words = F.filter(F.split(t, SPACE), lambda w: w != "")
    out = docs.withColumn("_sl_f", _given(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("c"), repeated_words(w).alias("r"))))
    out = out.withColumn("_sl_l", _given(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d"))))
    return out.select(
        *docs.columns,
        F.col("_sl_f.n").alias("n_words"),
        F.col("_sl_f.c").alias("word_chars"),
        gone("[#*$%&|<>]+").alias("n_symbols"),
        F.col("_sl_l.d").alias("n_dup_lines"),
        F.col("_sl_f.r").alias("n_repeat_words"),
        F.col("_sl_l.n").alias("n_lines"),
        gone("[A-Z]+").alias("n_upper"),
    )


def scores() -> list[Column]:
    bp = lambda part, whole: F.when(F.col(whole) > 0, F.floor(F.lit(10000) * F.col(part) / F.col(whole))).otherwise(F.lit(0)).cast("long")
    pairs = [("n_symbols", "word_chars"), ("n_repeat_words", "n_words"), ("n_dup_lines", "n_lines"), ("n_upper", "word_chars")]
    return [bp(a, b).alias(name) for name, (a, b) in zip(SCORES, pairs, strict=True)]


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X ~ Bin(n, p), summed in log space; 1 where k >= n * p (no test passes there)."""
    step = lambda s, j: F.struct(
        (s["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p)))).alias("term"),
        (s["top"] + F.log1p(F.exp(s["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p))) - s["top"]))).alias("top"),
    )
    first = n * F.log1p(F.lit(-p))
    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("term"), first.alias("top")), step, lambda s: F.exp(s["top"]))
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(total)


def cutoffs(scored: DataFrame, labels: DataFrame, stratum: str = "lang", risk: float = 0.05, delta: float = 0.05, grid=GRID) -> DataFrame:
    """(stratum, <score>_cut, ...), one row for each stratum with labelled good documents.

    scored: doc_id, stratum and SCORES. labels: doc_id, quality (1 good). Each labelled document adds
    one count to the histogram (over the grid) of each rule; the tests run on those histograms."""
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_sl_q")).where("_sl_q = 1").select("doc_id")
    held = scored.select("doc_id", F.col(stratum).alias("_sl_stratum"), *SCORES).join(good, "doc_id")
    steps = F.array(*[F.lit(c).cast("long") for c in sorted(grid)])
    reached = lambda s: F.coalesce(F.array_max(F.filter(steps, lambda c: c <= F.col(s))), F.lit(0))
    one = held.select("_sl_stratum", F.explode(F.array(*[F.struct(F.lit(s).alias("rule"), reached(s).alias("at")) for s in SCORES])).alias("_sl_x"))
    bars = one.groupBy("_sl_stratum", "_sl_x.rule", "_sl_x.at").agg(F.count("*").alias("n"))
    # at most len(grid) + 1 bars a rule and stratum
    per = bars.groupBy("_sl_stratum", "rule").agg(F.sum("n").alias("n"), F.collect_list(F.struct("at", "n")).alias("bars"))
    tests = per.select("_sl_stratum", "rule", "n", "bars", F.explode(steps).alias("cut"))
    tests = tests.withColumn("k", F.aggregate("bars", F.lit(0).cast("long"), lambda acc, b: acc + F.when(b["at"] >= F.col("cut"), b["n"]).otherwise(0))).drop("bars")
    strata = per.select("_sl_stratum").distinct().agg(F.count("*").alias("_sl_strata"))
    share = risk / len(SCORES)
    tests = tests.join(strata).withColumn("ok", binomial_tail(F.col("k"), F.col("n"), share) <= F.lit(delta) / (F.col("_sl_strata") * len(SCORES)))
    run = W.partitionBy("_sl_stratum", "rule").orderBy(F.desc("cut")).rowsBetween(W.unboundedPreceding, 0)
    passed = tests.withColumn("ok", F.bool_and("ok").over(run)).where("ok")
    return passed.groupBy("_sl_stratum").agg(*[F.min(F.when(F.col("rule") == s, F.col("cut"))).alias(f"{s}_cut") for s in SCORES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", keep_text: bool = True, **risk) -> DataFrame:
    """docs with base counts, base_failed and kept, and the scores. All rows stay, and all columns but those of the
    same names as the new ones, which these replace (see ``good`` for rows as they were).

    The counted documents are written once; cutoffs and verdicts read that table, so a text is
    searched once. The cutoffs (one row a stratum) join by Spark's own choice of strategy."""
    own = [c for c in docs.columns if c in {*BASE, *SCORES, "n_lines", "n_upper", "base_failed", "kept"}]
    counted = features(docs.drop(*own), text)
    counted = counted if keep_text else counted.drop(text)
    table = written(counted.select("*", *scores()))
    cuts = cutoffs(table, labels, stratum, **risk)
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.col(s) >= F.col(f"{s}_cut"), F.lit(False)) for s in SCORES])
    joined = table.join(cuts, F.col(stratum).eqNullSafe(F.col("_sl_stratum")), "left")
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~hit).drop("_sl_stratum", *[f"{s}_cut" for s in SCORES])


def good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that are kept, with all their columns as they were."""
    own = {c: f"_sl_own_{i}" for i, c in enumerate(docs.columns) if c in {*BASE, *SCORES, "n_lines", "n_upper", "base_failed", "kept"}}
    kept = judge(docs.withColumnsRenamed(own), labels, **options).where("kept")
    return kept.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])
