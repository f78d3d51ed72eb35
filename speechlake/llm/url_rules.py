"""URL filters: fixed host and path rules first, mined association rules for the rest.

Fixed rules: the longest rule that fits decides. For urls that no fixed rule fits, FP-growth over
labelled urls finds combinations of url tokens that go with bad labels. A rule stays if enough
labelled urls carry it (support), enough of those are bad (confidence), chance does not explain it, and no part of its
combination is as sure already. Chance: the lower Wilson bound of the bad share must lie above the share among all
labelled urls, at a level of ``alpha`` divided by the number of combinations that were tried, so that with labels that
don't depend on urls any rule at all is found with a probability of about ``alpha``. An inverted index (each rule under its rarest token) finds the rules
that a url may satisfy; the whole combination is then compared.

A page's labels are those of the same number: labels name rows by doc_id alone, and pages are numbered alike.

Null url or one without ``://``: empty host and path, no tokens, verdict ``allow``. Urls that repeat are
judged once and joined back. Empty tables and tables without bad labels: no mined rules. Very long urls: judged
whole. Other columns of pages play no part, whatever their names.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
BAD = "label=bad"


def host(url: Column) -> Column:
    """From the first :// up to /, ?, # or the end; A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def fits(host: Column, path: Column, rule_host: str, rule_path: str) -> Column:
    return ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; nulls where none does."""
    longest = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in reversed(longest):
        fit = fits(host, path, h, p)
        rule, verdict = F.when(fit, F.lit(h + p)).otherwise(rule), F.when(fit, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column) -> Column:
    """Host labels with their distance from the end, the parts of hyphenated ones, and the words of the path."""
    labels = F.reverse(F.split(host, r"\."))
    hosts = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit(":"), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[/._~+=-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x))
    # A label without a hyphen is one token only: a second form of it would double all its combinations.
    hyphened = F.flatten(F.transform(F.filter(F.split(host, r"\."), lambda x: x.contains("-")), lambda x: F.split(x, "-")))
    parts = F.transform(F.filter(hyphened, lambda x: x != ""), lambda x: F.concat(F.lit("word:"), x))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(hosts, words, parts)))


def lower_bound(hits: Column, n: Column, z: float) -> Column:
    """Lower end of Wilson's interval for the share hits / n."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def mine(labelled: DataFrame, min_count: int = 20, min_share: float = 0.0005, min_confidence: float = 0.8, longest: int = 4, alpha: float = 0.01) -> DataFrame:
    """labelled (tokens array<string>, bad boolean) -> rules (rule_id, items, anchor, confidence, n).

    Support: at least ``min_count`` labelled urls and ``min_share`` of them carry the combination and a
    bad label. Combinations have at most ``longest`` tokens. The anchor is the combination's rarest token."""
    spark = labelled.sparkSession
    n, n_bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    schema = "rule_id long, items array<string>, anchor string, confidence double, n long"
    if not n:
        return spark.createDataFrame([], schema)
    baskets = labelled.select(F.when(F.col("bad"), F.array_append("tokens", F.lit(BAD))).otherwise(F.col("tokens")).alias("items"))
    sets = written(FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_count / n, min_share)), minConfidence=1.0).fit(baskets).freqItemsets)
    with_bad = sets.where(F.array_contains("items", BAD) & F.size("items").between(2, longest + 1))
    with_bad = with_bad.select(F.array_sort(F.array_remove("items", BAD)).alias("items"), F.col("freq").alias("hits"))
    base = sets.where(~F.array_contains("items", BAD)).select(F.array_sort("items").alias("items"), "freq")
    # Every frequent combination was tried, with or without enough bad labels.
    tried = base.where(F.size("items") <= longest).count()
    z = NormalDist().inv_cdf(1 - alpha / max(1, tried))
    rules = with_bad.join(base, "items").withColumn("confidence", F.col("hits") / F.col("freq"))
    rules = rules.where((F.col("confidence") >= min_confidence) & (lower_bound(F.col("hits"), F.col("freq"), z) > n_bad / n))
    rules = written(rules.select(F.xxhash64("items").alias("rule_id"), "items", "confidence", F.col("hits").alias("n")))
    # Redundant: one of its parts, one token shorter, is a rule and as sure.
    part = F.transform("items", lambda x: F.xxhash64(F.array_remove("items", x)))
    known = rules.select(F.col("rule_id").alias("_sl_part"), F.col("confidence").alias("_sl_sure"))
    weak = rules.select("rule_id", "confidence", F.explode(part).alias("_sl_part")).join(known, "_sl_part").where("_sl_sure >= confidence").select("rule_id").distinct()
    kept = rules.join(weak, "rule_id", "left_anti")
    single = sets.where(F.size("items") == 1).select(F.col("items")[0].alias("_sl_token"), F.col("freq").alias("_sl_freq"))
    anchor = kept.select("rule_id", F.explode("items").alias("_sl_token")).join(single, "_sl_token").groupBy("rule_id").agg(F.min(F.struct("_sl_freq", "_sl_token")).alias("_sl_a"))
    return kept.join(anchor, "rule_id").select("rule_id", "items", F.col("_sl_a._sl_token").alias("anchor"), "confidence", "n")


def matches(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls (url, tokens, one row each) -> (url, mined_rule, confidence) of the surest rule that fits."""
    index = rules.select(F.col("anchor").alias("_sl_anchor"), F.col("items").alias("_sl_items"), F.col("confidence").alias("_sl_c"))
    found = urls.select("url", "tokens", F.explode("tokens").alias("_sl_anchor")).join(index, "_sl_anchor").where(F.size(F.array_except("_sl_items", "tokens")) == 0)
    best = found.groupBy("url").agg(F.max(F.struct("_sl_c", "_sl_items")).alias("_sl_b"))
    return best.select("url", F.array_join("_sl_b._sl_items", " & ").alias("mined_rule"), F.col("_sl_b._sl_c").alias("confidence"))


def judge(pages: DataFrame, labels: DataFrame, url: str = "url", page_id: str = "page_id", rules=RULES, **mining) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule for every page. labels: doc_id (a page_id), quality, toxic."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    told = labels.where("doc_id is not null and (quality is not null or toxic is not null)")
    # A null label says nothing; what is left decides.
    one = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    bad = told.groupBy("doc_id").agg(F.bool_or(one).alias("bad"))
    h, p = host(F.col("url")), path(F.col("url"))
    labelled = rows.join(bad, F.col("page_id") == F.col("doc_id")).select(tokens(h, p).alias("tokens"), "bad")
    mined = written(mine(written(labelled), **mining))
    urls = rows.where("url is not null").select("url").distinct()
    found = matches(urls.withColumn("tokens", tokens(h, p)), mined)
    out = rows.join(found, "url", "left").select("page_id", h.alias("host"), p.alias("path"), "mined_rule")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "mined_rule")
