"""Deduplication across packages, conflicts, hold-out split, shards, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import numbered, written


def winners(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, winner struct<order>, n): the least row of each key. Only keys and order columns are shuffled."""
    return rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("winner"), F.count("*").alias("n"))


def duplicates(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows that are not their key's winner, with the winner that was kept."""
    return rows.join(winners(rows, keys, order).where("n > 1"), keys).where(F.struct(*order) != F.col("winner")).drop("n")


def text_keyed(rows: DataFrame, order: list[str], digest: str = "audio_sha256", text: str = "text") -> DataFrame:
    """digest, text_sha256, order columns: what is shuffled instead of texts."""
    return rows.select(digest, F.sha2(text, 256).alias("text_sha256"), *order)


def conflicts(rows: DataFrame, digest: str = "audio_sha256", text: str = "text") -> DataFrame:
    """Digests with more than one text, their sorted texts and n_rows: for a look at digests of few texts
    (``conflict_rows`` has one row a text)."""
    found = conflict_rows(text_keyed(rows.withColumn("_t", F.col(text)), ["_t"], digest, text), ["_t"], digest)
    return found.groupBy(digest).agg(F.array_sort(F.collect_list("first._t")).alias("texts"), F.sum("n_rows").alias("n_rows"))


def conflict_rows(keyed: DataFrame, order: list[str], digest: str = "audio_sha256") -> DataFrame:
    """Every text of the digests that have more than one: digest, text_sha256, first (its least row), n_rows, n_texts.

    keyed: as from ``text_keyed``. One row a text, so a digest with many texts is no single large value."""
    per = keyed.groupBy(digest, "text_sha256").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n_rows"))
    many = per.groupBy(digest).agg(F.count("*").alias("n_texts")).where("n_texts > 1")
    return per.join(many, digest)


def aggregated(rows: DataFrame, order: list[str], digest: str = "audio_sha256", text: str = "text") -> DataFrame:
    """digest, text and the order columns of the least row of each digest; none for digests with conflicting texts.
    Hashes decide; the texts of the rows kept are joined back."""
    kept = kept_rows(text_keyed(rows, order, digest, text), order, digest).drop("text_sha256").withColumnsRenamed({c: f"_k_{c}" for c in (digest, *order)})
    same = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in (digest, *order)]
    return rows.select(digest, text, *order).join(kept, same, "left_semi").dropDuplicates([digest, *order])


def kept_rows(keyed: DataFrame, order: list[str], digest: str = "audio_sha256") -> DataFrame:
    """digest, text_sha256 and the order columns of the least row of each digest; none for digests with conflicting
    texts. One aggregation by digest: its texts are equal if the least and the greatest hash are."""
    one = keyed.groupBy(digest).agg(F.min("text_sha256").alias("text_sha256"), F.max("text_sha256").alias("_t"), F.min(F.struct(*order)).alias("_w"))
    return one.where("text_sha256 = _t").select(digest, "text_sha256", "_w.*")


def holdout(rows: DataFrame, speaker: str, rank: str, k: int) -> DataFrame:
    """rows with split train or eval: in the order of rank (a hash) at most k rows become eval, but every
    speaker keeps a train row. A speaker's last row is never eval; of all others the first k are."""
    rows = written(rows)
    last = rows.groupBy(speaker).agg(F.max(rank).alias("_last"))
    chosen = rows.select(speaker, rank).join(last, speaker).where(F.col(rank) != F.col("_last")).orderBy(rank).limit(k).select(rank)
    return rows.join(chosen.withColumn("_e", F.lit(True)), rank, "left").withColumn("split", F.when(F.col("_e"), "eval").otherwise("train")).drop("_e")


def shards(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """rows with position and shard_id: consecutive blocks of size rows in order."""
    return numbered(rows, order, "position").withColumn("shard_id", F.floor(F.col("position") / size).cast("long"))


def manifest(sharded: DataFrame, digest: str) -> DataFrame:
    """shard_id, n_rows and a digest of the shard's row digests in order (a shard's rows are bounded)."""
    rows = F.array_sort(F.collect_list(F.struct("position", digest)))
    return sharded.groupBy("shard_id").agg(F.count("*").alias("n_rows"), F.sha2(F.array_join(F.transform(rows, lambda r: r[digest]), ""), 256).alias("digest"))


def tree_digest(shard_manifest: DataFrame) -> DataFrame:
    """One digest of all shard digests in order."""
    parts = F.array_sort(F.collect_list(F.struct("shard_id", "digest")))
    return shard_manifest.agg(F.count("*").alias("n_shards"), F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.transform(parts, lambda r: r["digest"]), ""), 256).alias("digest"))


def merkle(shard_manifest: DataFrame, fan: int = 16) -> DataFrame:
    """The tree of digests over a manifest (shard_id, n_rows, digest): level, node, n_rows, digest.

    Level 0 has the shards. A node of the next level has the digest of the digests of ``fan`` nodes in order, up to one
    root: no row holds more than ``fan`` digests, however many shards there are."""
    level = written(shard_manifest.select(F.lit(0).alias("level"), F.col("shard_id").alias("node"), "n_rows", "digest"))
    out, last = level, level.agg(F.max("node")).first()[0]
    while last:
        parts = F.array_sort(F.collect_list(F.struct("node", "digest")))
        up = level.groupBy((F.col("level") + 1).alias("level"), F.floor(F.col("node") / fan).alias("_up"))
        level = written(up.agg(F.sum("n_rows").alias("n_rows"), F.sha2(F.array_join(F.transform(parts, lambda p: p["digest"]), ""), 256).alias("digest")).select("level", F.col("_up").alias("node"), "n_rows", "digest"))
        out, last = out.unionByName(level), last // fan
    return out


def root_digest(shard_manifest: DataFrame, fan: int = 16) -> str:
    """The digest of the whole: of the tree's root ('' without shards)."""
    top = merkle(shard_manifest, fan).orderBy(F.desc("level")).first()
    return top["digest"] if top else ""


def first_difference(one: DataFrame, other: DataFrame, fan: int = 16) -> int | None:
    """The first shard in which two trees (as from ``merkle``) differ, from the root down: of each level only the ``fan``
    nodes below the last difference are compared. None if the trees are equal."""
    height = [t.agg(F.max("level")).first()[0] for t in (one, other)]
    if None in height:
        return None if height == [None, None] else 0
    # The lower tree is as if it had a higher one's left edge above it, so that comparison starts at the higher root.
    node, deep = 0, max(height)
    for level in range(deep, -1, -1):
        first = 0 if level == deep else node * fan
        sides = [t.where((F.col("level") == level) & F.col("node").between(first, first + fan - 1)).select("node", F.col("digest").alias(c)) for t, c in ((one, "a"), (other, "b"))]
        found = sides[0].join(sides[1], "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.min("node")).first()[0]
        if found is None:
            # Only where the heights differ: the levels below the lower root decide.
            if level <= min(height) or level == 0:
                return None
            found = first
        node = found
    return int(node)


def row_fingerprint(**columns: Column) -> Column:
    """sha256 of the row's canonical JSON: keys in order, nothing between them, non-ASCII characters as they are."""
    return F.sha2(F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)])), 256)


def token_digest(vocab: DataFrame) -> DataFrame:
    """n_tokens and one sha256 over all tokens in order of idx, each with its length as 8 bytes before it.

    A vocabulary is thousands of tokens (or characters, bounded by Unicode): it fits into one row."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("idx", "token"))), lambda t: F.concat(F.lpad(F.hex(F.octet_length(t["token"]).cast("long")), 16, "0"), F.hex(F.encode(t["token"], "UTF-8"))))
    return vocab.agg(F.count("*").alias("n_tokens"), F.sha2(F.unhex(F.array_join(parts, "")), 256).alias("digest"))


def wave_coverage(selected: DataFrame, inputs: DataFrame, wave: int) -> DataFrame:
    """Ids of waves up to ``wave`` that inputs lack, and inputs that are not selected up to there."""
    want = selected.where(F.col("wave") <= wave).select("id")
    return want.join(inputs.select("id"), "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(inputs.select("id").join(want, "id", "left_anti").withColumn("side", F.lit("extra")))
