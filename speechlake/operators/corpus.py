"""Corpus preparation: filters with recorded reasons, summaries, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import characters


def first_reason(*rules: tuple[str, Column]) -> Column:
    """The name of the first rule that a row breaks, else null. A null condition is not broken."""
    return F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules])


def ladder(rows: DataFrame, duration: Column, text: Column, vocab: list[str], lo: float, hi: float, min_chars: int = 3, path: Column | None = None, there: Column | None = None, sound: Column | None = None) -> DataFrame:
    """rows with reason, the first rule that a row breaks (else null), and details (of oov its characters, else null).

    malformed (no path or no text), relative_path, missing (not there), invalid_audio (not sound), duration,
    empty_text, short_text, oov. Rules of columns that are not given are left out."""
    outside = F.array_except(characters(text), F.array(*[F.lit(c) for c in vocab]))
    rules = [] if path is None else [("malformed", path.isNull() | (F.trim(path) == "") | text.isNull()), ("relative_path", ~path.startswith("/"))]
    rules += [] if there is None else [("missing", ~there)]
    rules += [] if sound is None else [("invalid_audio", ~sound)]
    rules += [("duration", ~duration.between(lo, hi)), ("empty_text", F.trim(text) == ""), ("short_text", F.length(text) < min_chars), ("oov", F.size(outside) > 0)]
    tagged = rows.withColumn("reason", first_reason(*rules))
    return tagged.withColumn("details", F.when(F.col("reason") == "oov", F.array_join(F.array_sort(outside), "")))


def split_rejects(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tagged.where("reason is null").drop("reason"), tagged.where("reason is not null")


def not_listed(rows: DataFrame, blocklist: DataFrame, keys: list[str]) -> DataFrame:
    """rows whose keys are not in the blocklist. Spark broadcasts a list that its size allows."""
    return rows.join(blocklist, keys, "left_anti")


def contains_any(text: Column, parts: list[str]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(text, F.lit(p))
    return out


def source_reason(text: Column, speaker: Column) -> Column:
    return first_reason(("empty_text", text.isNull() | (F.trim(text) == "")), ("invalid_speaker", speaker.contains("　")))


def contains_own(text: Column, language: Column, parts: dict[str, list[str]]) -> Column:
    """Whether the text holds a part that is forbidden in its own language."""
    out = F.lit(False)
    for name, own in parts.items():
        out = out | ((language == name) & contains_any(text, own))
    return F.coalesce(out, F.lit(False))


def full_summary(rows: DataFrame, by: list[str], kept: Column, text: str = "text") -> DataFrame:
    """As ``summary`` of the rows kept, with vocab_size (distinct characters of their texts) and dropped rows by group."""
    tagged = rows.withColumn("_kept", F.coalesce(kept, F.lit(False)))
    sizes = tokens(tagged.where("_kept"), text, tuple(by)).distinct().groupBy(*by).agg(F.count("*").alias("vocab_size"))
    lost = tagged.groupBy(*by).agg(F.count_if(~F.col("_kept")).alias("dropped"))
    own = lambda d, k: d.withColumnsRenamed({c: f"_{k}_{c}" for c in by})
    out = lost
    for k, d in enumerate((summary(tagged.where("_kept"), by), sizes)):
        out = out.join(own(d, k), [F.col(c).eqNullSafe(F.col(f"_{k}_{c}")) for c in by], "left").drop(*[f"_{k}_{c}" for c in by])
    return out.fillna(0, ["n_rows", "vocab_size"])


def declared_differences(rows: DataFrame, by: list[str], declared: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """by, and for each count whether what a manifest declares equals what is counted now (a group that either side lacks: false)."""
    now = rows.groupBy(*by).agg(*[F.count_if(c).alias(f"_now_{n}") for n, c in counts.items()])
    both = now.join(declared, by, "full_outer")
    return both.select(*by, *[F.coalesce(F.col(n) == F.col(f"_now_{n}"), F.lit(False)).alias(f"{n}_ok") for n in counts])


def summary(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, hours, min and max duration by group. rows: duration seconds."""
    return rows.groupBy(*by).agg(F.count("*").alias("n_rows"), F.round(F.sum("duration") / 3600, 6).alias("hours"), F.round(F.min("duration"), 6).alias("min_duration"), F.round(F.max("duration"), 6).alias("max_duration"))


def tokens(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = (), empty: bool = False) -> DataFrame:
    """Distinct characters of each row, so that few of them reach a shuffle. empty: an empty text has one token, itself (else none)."""
    return rows.select(*keep, F.explode(F.array_distinct(F.split(text, "") if empty else characters(F.col(text)))).alias("token"))


def vocabulary(rows: DataFrame, text: str = "text", ascii_too: bool = False, empty: bool = False) -> DataFrame:
    """Sorted distinct tokens with their index; the space is 0. Vocabularies are thousands of rows. empty: as in ``tokens``."""
    found = tokens(rows, text, empty=empty).distinct()
    if ascii_too:
        spark = rows.sparkSession
        found = found.union(spark.range(32, 127).select(F.chr("id"))).union(spark.range(192, 256).select(F.chr("id"))).distinct()
    order = W.orderBy(F.when(F.col("token") == " ", 0).otherwise(1), "token")
    return found.select("token", (F.row_number().over(order) - 1).cast("long").alias("idx"))


def out_of_vocabulary(rows: DataFrame, vocab: DataFrame, order: str, text: str = "text") -> DataFrame:
    """token, n (documents), first_seen (smallest order) of tokens that the vocabulary lacks."""
    return tokens(rows, text, (order,)).join(vocab.select("token"), "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))


def extended(base: DataFrame, more: DataFrame) -> DataFrame:
    """base (token, idx) and after it, in token order, the tokens of more that base lacks."""
    new = more.select("token").join(base.select("token"), "token", "left_anti")
    start = base.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("_start"))
    return base.unionByName(new.join(start).select("token", (F.row_number().over(W.orderBy("token")) - 1 + F.col("_start")).cast("long").alias("idx")))


def remap(target: DataFrame, source: DataFrame) -> DataFrame:
    """Row of each target token in an embedding matrix (row 0 is filler): source idx + 1 if shared, else a running new index."""
    both = target.join(source.select("token", (F.col("idx") + 1).alias("source_row")), "token", "left")
    new = F.when(F.col("source_row").isNull(), F.row_number().over(W.partitionBy(F.col("source_row").isNull()).orderBy("idx")))
    return both.select("token", (F.col("idx") + 1).alias("target_row"), "source_row", new.cast("long").alias("new_index"))


def token_ids(tokens: Column, vocab: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with ids: index of each token, 0 for unknown ones.

    Single characters are looked up by code point in one array (at most 0x110000 entries, 9 MB, whatever the
    vocabulary). Longer tokens, if any, are looked up in one map of those alone."""
    single = vocab.where(F.char_length("token") == 1).select(F.ascii("token").cast("long").alias("_at"), "idx")
    top = single.agg(F.coalesce(F.max("_at"), F.lit(0)).alias("_top")).first()[0]
    every = rows.sparkSession.range(top + 1).select(F.col("id").alias("_at")).join(single, "_at", "left")
    one = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.coalesce("idx", F.lit(0).cast("long")).alias("idx")))), lambda x: x["idx"]).alias("_ids"))
    long_ones = vocab.where(F.char_length("token") > 1)
    by_code = lambda t: F.coalesce(F.get("_ids", F.ascii(t)), F.lit(0).cast("long"))
    if long_ones.isEmpty():
        return rows.join(F.broadcast(one)).withColumn("ids", F.transform(tokens, by_code)).drop("_ids")
    one = one.join(long_ones.agg(F.map_from_entries(F.collect_list(F.struct("token", "idx"))).alias("_long")))
    of = lambda t: F.when(F.char_length(t) == 1, by_code(t)).otherwise(F.coalesce(F.col("_long")[t], F.lit(0).cast("long")))
    # Vocabularies of longer tokens have thousands of rows; Spark's size check decides on the broadcast.
    return rows.join(one).withColumn("ids", F.transform(tokens, of)).drop("_ids", "_long")


def plan_estimate(rows: DataFrame, gpus: int = 8, budget: int = 38400, rate: float = 93.75, updates: float = 1.2e6, warmup: int = 20000) -> DataFrame:
    """Frame budget, updates an epoch, epochs = int(updates / updates an epoch), warm-up. rows: duration."""
    one = rows.agg(F.max("duration").alias("m"), F.sum("duration").alias("total"))
    per = F.greatest(F.lit(1), F.ceil(F.col("total") * rate / (budget * gpus)))
    return one.select(F.ceil(F.greatest(F.col("m") * rate, F.lit(float(budget)))).cast("long").alias("frame_budget"), per.cast("long").alias("updates_per_epoch"), F.floor(F.lit(updates) / per).cast("long").alias("epochs"), F.greatest(F.lit(warmup), F.floor(F.lit(updates) * 0.05)).cast("long").alias("warmup_updates"))
