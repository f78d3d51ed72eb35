"""Evaluation: job matrix, resume, leakage, summaries, gates, verdicts, Pareto."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import gram_hashes, leakage_form
from ..tables import written
from .quantiles import Quantile, interpolated, quantiles


def matrix(systems: DataFrame, texts: DataFrame) -> DataFrame:
    """systems (system_id) x texts (text_id): a product by definition; both sides are small dimensions."""
    return systems.crossJoin(texts).withColumn("job_id", F.concat_ws("__", F.col("system_id").cast("string"), F.col("text_id").cast("string")))


def with_references(jobs: DataFrame, texts: DataFrame, references: DataFrame) -> DataFrame:
    """jobs (text_id) with their text's reference_id and the reference's own columns; jobs without one go."""
    return jobs.join(texts, "text_id").join(references, "reference_id")


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key; map-side combined, no window."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*")


def unfinished(jobs: DataFrame, log: DataFrame, key: str, order: str, ok: Column, existing: DataFrame | None = None) -> DataFrame:
    """Jobs whose latest record is not ok; with ``existing`` (key), only those whose files are there."""
    left = jobs.join(latest(log, [key], order).where(ok).select(key), key, "left_anti")
    return left if existing is None else left.join(existing.select(key), key, "left_semi")


def merged_metrics(own: DataFrame, other: DataFrame, keys: list[str], own_fields: list[str], other_field: str, order: str) -> DataFrame:
    """keys, the last own_fields of ok rows of one log, other_field of the other log alone, failed rows of both.

    own, other: keys, order, ok, fields. What the first log says of other_field is foreign and is ignored."""
    a = overlaid(own.where("ok"), keys, own_fields, order)
    b = overlaid(other.where("ok").where(F.col(other_field).isNotNull()), keys, [other_field], order)
    failed = own.select(*keys, "ok").unionByName(other.select(*keys, "ok")).groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("failed"))
    return failed.join(a, keys, "left").join(b, keys, "left")

def overlaid(log: DataFrame, keys: list[str], fields: list[str], order: str) -> DataFrame:
    """For each field its last non-null value."""
    return log.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


#: Item grams that are broadcast at once, 16 bytes each. One of so many documents gives first bounds.
_BLOCK, _FIRST = 2_000_000, 64


def leakage(items: DataFrame, corpus: DataFrame, n: int = 3, threshold: float = 0.6) -> DataFrame:
    """items (item_id, text) against corpus (doc_id, text): best n-gram Jaccard, exact match, leaked.

    Pairs without a common n-gram count 0; two texts of fewer than n characters each count 1. A set-similarity join:
    a small share of the documents gives each item a best value so far. A document can only be better if sizes allow it
    and enough of the item's rarer grams are in it; only those (the item's prefix, rarest first among all items) are
    looked up, and only pairs with as many common ones as it takes are counted in full. So bounds prune, and the
    maximum is exact. Items go in blocks of about ``_BLOCK`` grams, one scan of the corpus each."""
    a = written(items.select("item_id", leakage_form(F.col("text")).alias("t")).withColumn("g", gram_hashes(F.col("t"), n)))
    size = a.agg(F.coalesce(F.sum(F.size("g") + 1), F.lit(0))).first()[0]
    forms = corpus.select(leakage_form(F.col("text")).alias("t")).where("t is not null").select("t", F.xxhash64("t").alias("_h"))
    blocks, found = max(1, -(-size // _BLOCK)), None
    for k in range(blocks):
        one = _best_matches(a.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k), forms, n)
        found = one if found is None else found.unionByName(one)
    short = forms.where(F.length("t") < n).limit(1).agg((F.count("*") > 0).alias("_short"))
    texts = a.select("item_id", F.col("t").alias("_t"), F.xxhash64("t").alias("_h"))
    # As many rows as items that are documents.
    exact = forms.join(texts, ["_h"]).where("t = _t").select("item_id").distinct().withColumn("_exact", F.lit(True))
    out = a.select("item_id", (F.size("g") == 0).alias("_empty")).join(found, "item_id", "left").join(exact, "item_id", "left").join(F.broadcast(short))
    j = F.when(F.col("_empty"), F.when(F.col("_short"), 1.0).otherwise(0.0)).otherwise(F.coalesce("j", F.lit(0.0)))
    out = out.select("item_id", F.round(j, 6).alias("max_jaccard"), F.coalesce("_exact", F.lit(False)).alias("exact"))
    return out.withColumn("leaked", F.col("exact") | (F.col("max_jaccard") >= threshold))


def _best_matches(items: DataFrame, forms: DataFrame, n: int) -> DataFrame:
    """(item_id, j) for the items that share a gram with some document; j is the greatest Jaccard similarity."""
    own = written(items.where(F.size("g") > 0).select("item_id", F.size("g").alias("_a"), F.explode("g").alias("g")))

    def shared(documents: DataFrame, postings: DataFrame) -> DataFrame:
        """(document's hash, item_id, sizes _a and _b, common grams _k) of pairs that postings bring together.

        Documents whose size no item allows end before their grams are looked up."""
        low, high = postings.agg(F.min(F.col("_best") * F.col("_a")), F.max(F.col("_a") / F.greatest("_best", F.lit(1e-9)))).first()
        # Exploded from an array of one, so that the grams are made once and not for each use.
        grams = documents.select("_h", F.explode(F.array(gram_hashes(F.col("t"), n))).alias("_y")).withColumn("_b", F.size("_y"))
        grams = grams.where((F.col("_b") > (low or 0.0) - 1e-9) & (F.col("_b") < (high or 0.0) + 1e-9)).select("_h", "_b", F.explode("_y").alias("g"))
        met = grams.join(F.broadcast(postings), "g").where(F.least("_a", "_b") > F.col("_best") * F.greatest("_a", "_b"))
        # Equal texts add up to more than they share, which only lets a pair pass that is then counted in full.
        return met.groupBy("_h", "item_id").agg(F.count("*").alias("_k"), *[F.first(c).alias(c) for c in ("_a", "_b", "_best")])

    jaccard = F.col("_k") / (F.col("_a") + F.col("_b") - F.col("_k"))
    some = forms.where(F.pmod("_h", F.lit(_FIRST)) == 0).dropDuplicates(["_h"])
    best = written(shared(some, own.withColumn("_best", F.lit(0.0))).groupBy("item_id").agg(F.max(jaccard).alias("j")))
    # Rarest first among the items; the common grams at the end, half as many as any better document must share, are left out.
    rank = F.row_number().over(W.partitionBy("item_id").orderBy("_f", "g"))
    known = own.join(own.groupBy("g").agg(F.count("*").alias("_f")), "g").join(best, "item_id", "left").withColumn("_best", F.coalesce("j", F.lit(0.0)))
    last = F.floor(F.col("_best") * F.col("_a") / 2).cast("int")
    prefix = written(known.withColumn("_r", rank).where(F.col("_r") <= F.col("_a") - last).select("item_id", "g", "_a", "_best"))
    need = F.col("_best") / (1 + F.col("_best")) * (F.col("_a") + F.col("_b"))
    likely = shared(forms, prefix).where(F.col("_k") + last > need - F.lit(1e-9)).select("_h", "item_id").distinct()
    likely = written(likely)
    # Only documents of likely pairs are opened again; their whole sets of grams are compared.
    sets = items.select("item_id", F.col("g").alias("_x"))
    pairs = forms.join(likely.select("_h").distinct(), "_h", "left_semi").dropDuplicates(["_h", "t"]).select("_h", F.explode(F.array(gram_hashes(F.col("t"), n))).alias("_y")).join(likely, "_h").join(sets, "item_id")
    both = F.size(F.array_intersect("_x", "_y"))
    exact = pairs.select("item_id", (both / (F.size("_x") + F.size("_y") - both)).alias("j"))
    return best.unionByName(exact).groupBy("item_id").agg(F.max("j").alias("j"))


def passed(judged: DataFrame, baseline: Column, texts: int, count: str, hard: str) -> DataFrame:
    """judged (as from ``verdicts``) with complete (as many rows as texts) and passed: complete, no hard failure, and
    the baseline itself or a verdict that holds."""
    ok = baseline | F.coalesce(F.col("verdict"), F.lit(False))
    return judged.withColumn("complete", F.col(count) == texts).withColumn("passed", F.col("complete") & (F.col(hard) == 0) & ok)


def metric_summary(rows: DataFrame, by: list[str], metric: str, core: Column | None = None, more: dict[str, Column] | None = None) -> DataFrame:
    """count, mean, exact median (between the middle two), p10, p90 (nearest rank), max over the non-null values of a
    metric; with ``core`` also median, p90 and max over those rows; and other aggregates of the rows."""
    # Summed as decimals (12 places), so the mean does not depend on how the rows are spread.
    mean = (F.sum(F.col(metric).cast("decimal(28,12)")) / F.count(metric)).cast("double")
    own = [F.count(metric).alias(f"{metric}_n"), F.round(mean, 6).alias(f"{metric}_mean"), F.max(metric).alias(f"{metric}_max"), *[c.alias(n) for n, c in (more or {}).items()]]
    picks = {f"{metric}_median": Quantile(metric, 0.5, linear=True), f"{metric}_p10": Quantile(metric, 0.1), f"{metric}_p90": Quantile(metric, 0.9)}
    if core is not None:
        own.append(F.max(F.when(core, F.col(metric))).alias(f"core_{metric}_max"))
        picks |= {f"core_{metric}_median": Quantile(metric, 0.5, linear=True, where=core), f"core_{metric}_p90": Quantile(metric, 0.9, where=core)}
    found = quantiles(rows, by, picks).withColumns({n: F.round(n, 6) for n, p in picks.items() if p.linear})
    return rows.groupBy(*by).agg(*own).join(found, by, "left")


def gate_failures(gates: dict[str, Column]) -> Column:
    """Names of the gates that do not hold; a null metric fails its gate."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in gates.items()]))


def verdicts(summary: DataFrame, baseline: Column, checks: dict[str, tuple[str, str, float]]) -> DataFrame:
    """Each check compares a metric's difference from the baseline's one row with a limit: name -> (metric,
    '<=' or '>=', limit). A null metric makes the check null, and a null check the verdict."""
    base = summary.where(baseline).select(*[F.col(m).alias(f"_b_{m}") for m in dict.fromkeys(m for m, _, _ in checks.values())])
    j = summary.join(F.broadcast(base.limit(1)))
    for name, (m, op, limit) in checks.items():
        d = F.col(m) - F.col(f"_b_{m}")
        j = j.withColumn(name, d <= limit if op == "<=" else d >= limit)
    known = [F.col(n).isNotNull() for n in checks]
    all_known, all_ok = known[0], F.col(next(iter(checks)))
    for n in list(checks)[1:]:
        all_known, all_ok = all_known & F.col(n).isNotNull(), all_ok & F.col(n)
    return j.withColumn("verdict", F.when(all_known, all_ok)).drop(*base.columns)


def pareto(rows: DataFrame, key: str, lower: list[str], higher: list[str]) -> DataFrame:
    """Rows that no other row dominates; null metrics are skipped pair by pair, so rows without a common metric
    leave each other alone.

    Rows with the same metrics known (one pattern) are compared first. Dominance is transitive there, and what a row
    dominates in any pattern its dominator dominates, too, so a pattern's skyline decides for all its rows. It is merged
    in a tree: tasks keep the skyline of their rows, then ever larger groups of what is left. Then each pattern's rows are
    tested against the other patterns' skylines, reduced to the metrics that both know. Groups hold skylines, not
    rows: of n rows spread at random about log(n) to the power of the metrics but one."""
    metrics = [*lower, *higher]
    columns = rows.columns
    pattern = sum((F.col(m).isNotNull().cast("int") * (1 << i) for i, m in enumerate(metrics)), F.lit(0))
    costs = [((-1 if m in higher else 1) * F.col(m).cast("double")).alias(f"_c{i}") for i, m in enumerate(metrics)]
    own = _merged_skyline(rows.select(*columns, *costs, pattern.alias("_p")), ["_p"], len(metrics))
    # (pattern to test, what both know, the skyline there)
    # At most 2 to the number of metrics patterns.
    kinds = [r["_p"] for r in own.select("_p").distinct().collect()]
    seen = own.select(F.col("_p").alias("_of"), *[f"_c{i}" for i in range(len(metrics))], F.explode(F.lit(kinds).cast("array<int>")).alias("_q"))
    met = seen.where((F.col("_q") != F.col("_of")) & (F.col("_q").bitwiseAND(F.col("_of")) != 0))
    both = F.col("_q").bitwiseAND(F.col("_of"))
    against = met.select("_q", both.alias("_p"), *[F.when(both.bitwiseAND(1 << i) != 0, F.col(f"_c{i}")).alias(f"_c{i}") for i in range(len(metrics))])
    against = _merged_skyline(against.distinct(), ["_q", "_p"], len(metrics))
    tested = own.groupBy("_p").cogroup(against.groupBy("_q")).applyInPandas(_undominated(len(metrics)), own.schema)
    return tested.select(*columns)


#: Rows of a group when a skyline is merged first.
_MERGED = 50_000


def _merged_skyline(rows: DataFrame, kind: list[str], m: int) -> DataFrame:
    """The rows that no row with equal values of ``kind`` (the last of which is the pattern of known metrics) dominates."""
    cost = [f"_c{i}" for i in range(m)]

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        known = [c for c in cost if pdf[c].notna().iloc[0]] if len(pdf) else []
        return pdf[_skyline(pdf[known].to_numpy(dtype=float))] if known else pdf

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        top: dict[tuple, pd.DataFrame] = {}
        for pdf in batches:
            for at, some in pdf.groupby(kind):
                top[at] = keep(pd.concat([top[at], some], ignore_index=True) if at in top else some)
        yield from top.values()

    left = written(rows.mapInPandas(local, rows.schema))
    groups = max(1, -(-left.count() // _MERGED))
    while True:
        # Equal rows dominate nothing among themselves, so any spread over groups will do.
        left = written(left.groupBy(*kind, F.pmod(F.xxhash64(*cost), F.lit(groups))).applyInPandas(keep, rows.schema))
        if groups == 1:
            return left
        groups = max(1, groups // 8)


def _skyline(cost: np.ndarray) -> np.ndarray:
    """Which rows no row dominates. In lexicographic order no row dominates an earlier one."""
    out = np.zeros(len(cost), dtype=bool)
    order = np.lexsort(cost.T[::-1])
    kept = np.empty((0, cost.shape[1]))
    for lo in range(0, len(order), 256):
        at = order[lo : lo + 256]
        at = at[~_dominated(cost[at], kept)]
        at = at[~_dominated(cost[at], cost[at])]
        out[at] = True
        kept = np.concatenate([kept, np.unique(cost[at], axis=0)])
    return out


def _dominated(rows: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which rows some row of ``by`` dominates."""
    out = np.zeros(len(rows), dtype=bool)
    for lo in range(0, len(by), 4096):
        some = by[lo : lo + 4096, None, :]
        out |= ((some <= rows).all(axis=2) & (some < rows).any(axis=2)).any(axis=0)
    return out


def _undominated(m: int):
    cost = [f"_c{i}" for i in range(m)]

    def run(own: pd.DataFrame, against: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(own), dtype=bool)
        if len(own):
            for _, some in against.groupby("_p"):
                known = [c for c in cost if some[c].notna().iloc[0]]
                by = np.unique(some[known].to_numpy(dtype=float), axis=0)
                for lo in range(0, len(own), 1024):
                    out[lo : lo + 1024] |= _dominated(own[known].iloc[lo : lo + 1024].to_numpy(dtype=float), by)
        return own[~out]

    return run


def latency(rows: DataFrame, by: list[str], elapsed: str, audio: str) -> DataFrame:
    """RTF = elapsed / audio; mean, population variance and interpolated percentiles of elapsed, times 1000."""
    stats = rows.groupBy(*by).agg(F.round(F.sum(elapsed) / F.sum(audio), 6).alias("rtf"), F.round(F.avg(elapsed) * 1000, 3).alias("mean_ms"), F.round(F.var_pop(elapsed) * 1000, 3).alias("variance"))
    names = {f"p{round(q * 100)}_ms": q for q in (0.5, 0.9, 0.95, 0.99)}
    p = interpolated(rows, by, elapsed, names).withColumns({name: F.round(F.col(name) * 1000, 3) for name in names})
    return stats.join(p, by, "left")


def response(rows: DataFrame, seed: str, alpha: str, value: str) -> DataFrame:
    """alpha, n, position mean, sample deviation (0 for one), error: where a value lies between the anchors
    at alpha 0 and alpha max of its seed; seeds with a span under 1e-6 are skipped."""
    ends = rows.groupBy(seed).agg(F.min_by(value, alpha).alias("_b"), F.max_by(value, alpha).alias("_a"), F.max(alpha).alias("_m"))
    at = rows.join(ends, seed).where(F.abs(F.col("_a") - F.col("_b")) >= 1e-6)
    at = at.withColumn("_p", (F.col(value) - F.col("_b")) / (F.col("_a") - F.col("_b")))
    return at.groupBy(alpha).agg(F.count("*").alias("n"), F.round(F.avg("_p"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("_p"), F.lit(0.0)), 6).alias("sd")).withColumn("error", F.round(F.col("mean") - F.col(alpha), 6))


def monotonicity(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    w = W.partitionBy(by).orderBy(*order)
    steps = rows.where(F.col(value).isNotNull()).withColumn("_p", F.lag(value).over(w))
    one = steps.groupBy(by).agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("_p") <= F.col(value) + 1e-6), F.lit(True)).alias("_up"), F.coalesce(F.bool_and(F.col("_p") >= F.col(value) - 1e-6), F.lit(True)).alias("_down"))
    return one.select(by, "n", F.when(F.col("n") < 3, "insufficient").when(F.col("_up"), "increasing").when(F.col("_down"), "decreasing").otherwise("non-monotone").alias("response"))


def blind_code(secret: str, job: Column) -> Column:
    return F.concat(F.lit("Y"), F.upper(F.substring(F.sha2(F.concat(F.lit(secret), F.lit("\0"), job), 256), 1, 10)))


def blind_order(items: list[tuple[str, str, str]], secret: str) -> list[int]:
    """Indexes of (job, system, text) in listening order: where possible no text twice in a row, no system
    three times in a row."""
    rng, pool, out = random.Random(int(hashlib.sha256(secret.encode()).hexdigest(), 16)), list(range(len(items))), []
    rng.shuffle(pool)
    while pool:
        fits = [i for i in pool if not (out and items[i][2] == items[out[-1]][2]) and not (len(out) > 1 and items[i][1] == items[out[-1]][1] == items[out[-2]][1])]
        pick = (fits or pool)[0]
        pool.remove(pick)
        out.append(pick)
    return out


def listening(jobs: DataFrame, secret: str) -> DataFrame:
    """bundle_id, job_id, code, place: one bundle (hundreds of jobs) is one group."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("job_id", ignore_index=True)
        order = blind_order(list(pdf[["job_id", "system_id", "text_id"]].astype(str).itertuples(index=False, name=None)), secret)
        return pdf.assign(place=pd.Series(range(len(order)), index=order).sort_index().astype("int64"))[["bundle_id", "job_id", "place"]]

    placed = jobs.select("bundle_id", "job_id", "system_id", "text_id").groupBy("bundle_id").applyInPandas(run, "bundle_id long, job_id string, place long")
    return placed.withColumn("code", blind_code(secret, F.col("job_id")))
