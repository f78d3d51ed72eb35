"""Package curation: key normalisation, reconciliation, violations, nested documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import numbered


def reconcile(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_left, n_right, verdict: matched, missing (right lacks it), extra (left lacks it) or repeated."""
    a = left.groupBy(*keys).agg(F.count("*").alias("n_left"))
    b = right.groupBy(*keys).agg(F.count("*").alias("n_right"))
    both = a.join(b, keys, "full_outer").fillna(0, ["n_left", "n_right"])
    verdict = F.when(F.col("n_right") == 0, "missing").when(F.col("n_left") == 0, "extra").when((F.col("n_left") > 1) | (F.col("n_right") > 1), "repeated").otherwise("matched")
    return both.withColumn("verdict", verdict)


def differences(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Key sets' difference both ways, as (keys, side)."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, keys, "left_anti").withColumn("side", F.lit("extra")))


def by_portable_key(indexed: DataFrame, inventory: DataFrame, path: str, key) -> DataFrame:
    """Indexed and inventory paths joined by a normalised key (a Column function): the inventory's spelling
    wins, the indexed one stays where it differs; verdict matched, missing or unindexed."""
    a = indexed.select(key(F.col(path)).alias("key"), F.col(path).alias("indexed_path"))
    b = inventory.select(key(F.col(path)).alias("key"), F.col(path).alias("inventory_path"))
    j = a.join(b, "key", "full_outer")
    verdict = F.when(F.col("inventory_path").isNull(), "missing").when(F.col("indexed_path").isNull(), "unindexed").otherwise("matched")
    return j.select("key", F.coalesce("inventory_path", "indexed_path").alias("path"), F.when(F.col("indexed_path") != F.col("inventory_path"), F.col("indexed_path")).alias("indexed_as"), verdict.alias("verdict"))


def mismatches(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """keys and the names of the fields that differ (null-safe) of joined rows."""
    r = right.select(*keys, *[F.col(f).alias(f"_r_{f}") for f in fields])
    found = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_r_{f}")), F.lit(f)) for f in fields]))
    return left.join(r, keys).withColumn("fields", found).where(F.size("fields") > 0).select(*keys, "fields")


def enriched(rows: DataFrame, extra: DataFrame, key: str, field: str, fallback: Column, to: str) -> DataFrame:
    return rows.join(extra.select(key, F.col(field).alias("_x")), key, "left").withColumn(to, F.coalesce("_x", fallback)).drop("_x")


def excluded(candidates: DataFrame, taken: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates that share none of the keys (each on its own) with those taken."""
    return reduce(lambda d, k: d.join(taken.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti"), keys, candidates)


def stratum(value: Column, strata: list[tuple[str, float, float]]) -> tuple[Column, Column]:
    """(name of the stratum [min, max), in how many strata the value lies)."""
    inside = [(value >= lo) & (value < hi) for _, lo, hi in strata]
    name = F.coalesce(*[F.when(i, F.lit(n)) for i, (n, _, _) in zip(inside, strata, strict=True)])
    return name, reduce(lambda a, b: a + b, [i.cast("int") for i in inside])


def violations(*rules: tuple[str, Column]) -> Column:
    """Names of all rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]))


def identity_rules(sha: Column, ident: Column, prefix: str, path: Column, size: Column) -> list[tuple[str, Column]]:
    return [("digest", ~sha.rlike("^([0-9a-f]{40}|[0-9a-f]{64})$")), ("id", ~ident.rlike(f"^{prefix}[0-9a-f]{{24}}$")), ("path", ~path.rlike(r"^[^/\\]+/[^/\\]+$") | path.contains("..")), ("size", ~(size > 0))]


def archive_limits(members: DataFrame, max_size: int, max_total: int, max_ratio: float, max_members: int) -> DataFrame:
    """Verdicts for each archive. members: archive, path, size, packed, folded (the portable key)."""
    one = members.groupBy("archive").agg(
        F.count("*").alias("n"), F.sum("size").alias("total"), F.sum("packed").alias("packed"), F.max("size").alias("largest"),
        F.countDistinct(F.element_at(F.split("path", "/"), 1)).alias("roots"), F.countDistinct("folded").alias("names"),
    )
    broken = violations(("member_size", F.col("largest") > max_size), ("total_size", F.col("total") > max_total), ("ratio", F.col("total") > F.col("packed") * max_ratio), ("members", F.col("n") > max_members), ("roots", F.col("roots") > 1), ("repeated_name", F.col("names") < F.col("n")))
    return one.select("archive", "n", "total", broken.alias("violations"))


def prefix_conflicts(members: DataFrame) -> DataFrame:
    """Files that are also a folder of another member, by folded path."""
    steps = F.split("folded", "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(steps) - 1), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    folders = members.where(F.size(steps) > 1).select("archive", F.explode(parents).alias("folded")).distinct()
    return members.join(folders, ["archive", "folded"], "left_semi").select("archive", "path")


def watermarks(total: float, soft: tuple[float, float] = (500 * 2**30, 0.12), hard: tuple[float, float] = (200 * 2**30, 0.05)) -> tuple[float, float]:
    """(soft, hard) bytes to keep free on a disk of that size: the larger of an amount and a share, each."""
    return max(soft[0], soft[1] * total), max(hard[0], hard[1] * total)


def artifact_plan(items: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """Items (key, size, digest) whose committed artifact has the same size and digest, and what is wrong with the
    others: key, verdict ready, no_artifact, size or digest."""
    a = artifacts.select(F.col(key).alias("_k"), F.col("size").alias("_s"), F.col("digest").alias("_d"))
    verdict = F.when(F.col("_k").isNull(), "no_artifact").when(~F.col("size").eqNullSafe(F.col("_s")), "size").when(~F.col("digest").eqNullSafe(F.col("_d")), "digest").otherwise("ready")
    return items.join(a, F.col(key) == F.col("_k"), "left").select(key, verdict.alias("verdict"))


def same_prefix(base: DataFrame, new: DataFrame, order: list[str], n: int) -> DataFrame:
    """Of the first n rows of both lists in order: place, whether the rows are equal (a missing one is not)."""
    first = lambda d: numbered(d.orderBy(*order).limit(n), order, "place")
    a = first(base).select("place", F.struct(*base.columns).alias("_a"))
    b = first(new).select("place", F.struct(*base.columns).alias("_b"))
    return a.join(b, "place", "full_outer").select("place", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("equal"))


def disk_classes(items: DataFrame, by: str, order: str, size: str, free: float, soft: float, hard: float, factor: int = 8) -> DataFrame:
    """normal, soft or hard: what is left free of each disk after all items up to this one took size * factor."""
    w = W.partitionBy(by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    left = F.lit(free) - F.sum(F.col(size) * factor).over(w)
    return items.withColumn("left", left).withColumn("class", F.when(left < hard, "hard").when(left < soft, "soft").otherwise("normal"))


def opened(docs: DataFrame, samples: str, count: str, keep: list[str], ident: str | None = None, text: str | None = None, digest: str | None = None) -> DataFrame:
    """Rows of nested packages with row_index; count_ok tells whether the declared count is right. With ``ident``
    unique_ids (no id of the package twice), with ``text`` and ``digest`` text_ok (the text has the declared sha256)."""
    ids = F.transform(samples, lambda s: s[ident]) if ident else None
    whole = [(F.size(samples) == F.col(count)).alias("count_ok")] + ([(F.size(F.array_distinct(ids)) == F.size(ids)).alias("unique_ids")] if ident else [])
    rows = docs.select(*keep, *whole, F.posexplode(samples).alias("row_index", "_s")).select(*keep, *[c for c in ("count_ok", "unique_ids") if c == "count_ok" or ident], "row_index", "_s.*")
    return rows.withColumn("text_ok", F.sha2(text, 256) == F.col(digest)) if text and digest else rows


def contiguity(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Rows whose order column is not 0..n-1 in its group."""
    at = F.row_number().over(W.partitionBy(*by).orderBy(order)) - 1
    return rows.withColumn("expected", at.cast("long")).where(F.col("expected") != F.col(order))


def registry_coverage(used: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """key, verdict: unregistered, unused or repeated in the registry."""
    return reconcile(used.select(key).distinct(), registry, [key]).where("verdict <> 'matched'").select(key, F.when(F.col("verdict") == "missing", "unregistered").when(F.col("verdict") == "extra", "unused").otherwise("repeated").alias("verdict"))


def resolved(paths: DataFrame, inventory: DataFrame, base: str, extensions: list[str]) -> DataFrame:
    """Absolute path with extension: itself. Name with extension: base/name. Bare name: the first extension
    (in the order given) that the inventory has, else base/name.wav. paths: path; inventory: name."""
    has = F.col("path").rlike(r"\.\w{2,4}$")
    rank = F.array_position(F.array(*[F.lit(e) for e in extensions]), F.regexp_extract("name", r"\.(\w+)$", 1))
    best = inventory.withColumn("_r", rank).where("_r > 0").groupBy(F.regexp_replace("name", r"\.\w+$", "").alias("path")).agg(F.min_by("name", "_r").alias("_n"))
    out = F.when(has & F.col("path").startswith("/"), F.col("path")).when(has, F.concat(F.lit(base + "/"), "path")).otherwise(F.concat(F.lit(base + "/"), F.coalesce("_n", F.concat("path", F.lit(".wav")))))
    return paths.join(best, "path", "left").withColumn("resolved", out).drop("_n")
