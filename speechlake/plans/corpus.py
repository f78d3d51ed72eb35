"""Queries over corpus operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectorized as V
from ..operators import audio, corpus
from ..registry import query
from ..sources import readers, sinks
from ..tables import scratch, table, written

UTT = "SELECT doc_id, text, lang, source, n_chars, n_chars / 15.0 AS duration FROM documents"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,\n"


def utterances(spark, sf_dir):
    """documents as utterances: 15 characters a second."""
    return table(spark, sf_dir, "documents").withColumn("duration", F.col("n_chars") / 15)


def lit_list(chars: str) -> str:
    return "[" + ", ".join("chr(10)" if c == "\n" else f"'{c}'" for c in chars) + "]"


@query("SELECT doc_id, text, lang, source, 'folder=' || source || '/' || doc_id || '.wav' AS wav FROM documents")
def s03_jsonl_corpus(spark, sf_dir):
    """documents written as JSON lines, in a folder for each source, and read with a path prefix from the file's folder."""
    path = scratch(spark)
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", F.concat("doc_id", F.lit(".wav")).alias("wav"), F.col("source").alias("folder"))
    d.write.partitionBy("folder").json(path)
    rows = readers.jsonl_corpus(spark, f"{path}/*", "doc_id long, text string, lang string, source string, wav string", "wav")
    return rows.select("doc_id", "text", "lang", "source", F.substring_index("wav", "/", -2).alias("wav"))


@query("SELECT conv_id::VARCHAR AS stem, conv_id, count(*) AS turns FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0")
def s04_rows_with_sibling(spark, sf_dir):
    """A JSON file for each conversation; the sibling .mp3 of every third one is missing."""
    one = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"))
    path = sinks.write_files(one.select(F.concat("conv_id", F.lit(".json")).alias("name"), F.to_json(F.struct("conv_id", "turns")).alias("body")), scratch(spark))
    sinks.write_files(one.where("conv_id % 3 <> 0").select(F.concat("conv_id", F.lit(".mp3")).alias("name"), F.lit("ID3").alias("body")), path)
    return readers.with_sibling(spark, path, "conv_id long, turns long", ".json", ".mp3")


@query("SELECT conv_id::VARCHAR AS stem, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS text FROM conversations WHERE turn = 0")
def s05_text_sidecars(spark, sf_dir):
    """The first turns, each in a file of its own beside its clip."""
    first = table(spark, sf_dir, "conversations").where("turn = 0").select(F.concat("conv_id", F.lit(".normalized.txt")).alias("name"), F.concat(F.lit(" "), F.regexp_replace("text", r"\s+", " "), F.lit("\n")).alias("body"))
    return readers.sidecars(spark, sinks.write_files(first, scratch(spark)), ".normalized.txt")


@query("SELECT conv_id::VARCHAR AS stem, trim(translate(text, chr(9) || chr(10) || chr(13), '   ')) AS text FROM conversations WHERE turn = 1")
def s05_tabbed_sidecars(spark, sf_dir):
    """Files whose first line is a name, a tab and the text."""
    second = table(spark, sf_dir, "conversations").where("turn = 1")
    body = F.concat("conv_id", F.lit("\t"), F.trim(F.translate("text", "\t\n\r", "   ")), F.lit("\nsecond line"))
    return readers.sidecars(spark, sinks.write_files(second.select(F.concat("conv_id", F.lit(".txt")).alias("name"), body.alias("body")), scratch(spark)), ".txt", tabbed=True)


@query("SELECT vec_id::VARCHAR AS stem, vec_id % 7 <> 0 AS ok, CASE WHEN vec_id % 7 <> 0 THEN 8000 END::INT AS sample_rate, CASE WHEN vec_id % 7 <> 0 THEN 1 END::INT AS channels, CASE WHEN vec_id % 7 <> 0 THEN 64 END::BIGINT AS frames, CASE WHEN vec_id % 7 <> 0 THEN 0.008 END::DOUBLE AS duration FROM embeddings")
def s14_audio_files(spark, sf_dir):
    """Embeddings written as PCM WAV files of 8 kHz; every seventh file is cut short."""
    @F.pandas_udf("binary")
    def wav(x: pd.Series, broken: pd.Series) -> pd.Series:
        whole = [audio.write_wav(np.clip(np.asarray(v, dtype=float), -1, 1), 8000) for v in x]
        return pd.Series([w[:20] if b else w for w, b in zip(whole, broken, strict=True)])

    rows = table(spark, sf_dir, "embeddings").select(F.concat("vec_id", F.lit(".wav")).alias("name"), wav("embedding", F.col("vec_id") % 7 == 0).alias("body"))
    found = readers.wav_files(spark, sinks.write_files(rows, scratch(spark)))
    return found.select(F.substring_index(F.substring_index("path", "/", -1), ".", 1).alias("stem"), "ok", "sample_rate", "channels", "frames", "duration")


@query(f"SELECT doc_id, round(duration, 6) AS duration FROM ({UTT}) WHERE duration BETWEEN 0.4 AND 30")
def f01_duration_range(spark, sf_dir):
    return utterances(spark, sf_dir).where(F.col("duration").between(0.4, 30)).select("doc_id", F.round("duration", 6).alias("duration"))


_LADDER = f"""SELECT doc_id, lang, reason, CASE WHEN reason = 'oov' THEN array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[^a-zA-Z .,\n]'))), '') END AS details FROM (
  SELECT *, CASE WHEN doc_id % 29 = 0 THEN 'malformed' WHEN doc_id % 31 = 0 THEN 'relative_path' WHEN doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 37 = 0 THEN 'invalid_audio'
  WHEN NOT (duration BETWEEN 0.3 AND 60) THEN 'duration' WHEN trim(text) = '' THEN 'empty_text' WHEN length(text) < 3 THEN 'short_text'
  WHEN regexp_matches(text, '[^a-zA-Z .,\n]') THEN 'oov' END AS reason FROM ({UTT}))"""


def _ladder(spark, sf_dir):
    """Every 29th document has no path, every 31st a relative one, every 37th a broken file; the inventory lacks every
    fifth document without labels."""
    i = F.col("doc_id")
    d = utterances(spark, sf_dir).withColumn("path", F.when(i % 29 == 0, F.lit("")).otherwise(F.concat(F.when(i % 31 == 0, F.lit("wavs/")).otherwise(F.lit("/wavs/")), i, F.lit(".wav"))))
    listed = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("_i")).distinct()
    d = d.join(listed, i == F.col("_i"), "left").withColumn("_there", F.col("_i").isNotNull() | (i % 5 != 0)).drop("_i")
    return corpus.ladder(d, F.col("duration"), F.col("text"), list(LETTERS), 0.3, 60, path=F.col("path"), there=F.col("_there"), sound=i % 37 != 0)


@query(f"SELECT doc_id, reason, details FROM ({_LADDER})")
def f02_rejection_ladder(spark, sf_dir):
    return _ladder(spark, sf_dir).select("doc_id", "reason", "details")


@query(f"SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n FROM ({_LADDER}) GROUP BY 1")
def a02_reason_histogram(spark, sf_dir):
    return _ladder(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, reason, details FROM ({_LADDER}) WHERE reason IS NOT NULL")
def s13_rejected_rows_sink(spark, sf_dir):
    """One pass tags; the rejected rows go to JSON with their reason and details and are read back."""
    path = scratch(spark)
    _, rejected = corpus.split_rejects(_ladder(spark, sf_dir).select("doc_id", "reason", "details"))
    rejected.write.json(path)
    return spark.read.schema("doc_id long, reason string, details string").json(path)


@query(f"""SELECT lang, lang <> 'fr' AS accepted_ok, lang <> 'de' AS rejected_ok, true AS source_ok FROM ({_LADDER}) GROUP BY lang UNION ALL SELECT 'xx', false, false, false""")
def a14_row_conservation(spark, sf_dir):
    """A manifest that declares one row too many accepted in French, rejected in German, and a language of its own."""
    rows = _ladder(spark, sf_dir)
    counts = {"accepted": F.col("reason").isNull(), "rejected": F.col("reason").isNotNull(), "source": F.lit(True)}
    told = rows.groupBy("lang").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])
    told = told.withColumn("accepted", F.col("accepted") + (F.col("lang") == "fr").cast("long")).withColumn("rejected", F.col("rejected") + (F.col("lang") == "de").cast("long"))
    told = told.unionByName(spark.createDataFrame([("xx", 1, 1, 2)], "lang string, accepted long, rejected long, source long"))
    return corpus.declared_differences(rows, ["lang"], told, counts)


@query("SELECT doc_id, lang, source FROM documents WHERE NOT ((lang = 'en' AND source IN ('src0', 'src3')) OR (lang = 'de' AND source = 'src5'))")
def f03_source_blocklist(spark, sf_dir):
    listed = spark.createDataFrame([("en", "src0"), ("en", "src3"), ("de", "src5")], "lang string, source string")
    return corpus.not_listed(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), listed, ["lang", "source"])


@query("SELECT doc_id FROM documents WHERE NOT ((lang = 'de' AND (contains(text, 'ß') OR contains(text, '###'))) OR (lang = 'en' AND contains(text, '|')) OR (lang = 'fr' AND contains(text, 'é')))")
def f04_forbidden_characters(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(~corpus.contains_own(F.col("text"), F.col("lang"), {"de": ["ß", "###"], "en": ["|"], "fr": ["é"]})).select("doc_id")


@query("""WITH p AS (SELECT doc_id, text, unnest(range(1, length(text))) AS i FROM documents),
  c AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, substr(text, i::BIGINT, 2) AS g FROM p) GROUP BY doc_id, g)
  SELECT d.doc_id, coalesce(max(c.n) > 100, false) AS repetitive FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id GROUP BY d.doc_id""")
def f05_repetition(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return rows.select("doc_id", V.repetition(2, 100)("text").alias("repetitive"))


@query("SELECT conv_id, turn, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty_text' WHEN contains(role, '　') THEN 'invalid_speaker' END AS reason FROM conversations")
def f06_source_rejection(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", corpus.source_reason(F.col("text"), F.col("role")).alias("reason"))


@query("""SELECT conv_id, turn, s AS declared, r AS recomputed FROM (SELECT conv_id, turn, CASE WHEN conv_id % 6 = 0 THEN 'rejected' ELSE 'accepted' END AS s,
  CASE WHEN trim(text) = '' OR length(text) < 25 THEN 'rejected' ELSE 'accepted' END AS r FROM conversations) WHERE s <> r""")
def f06_status_check(spark, sf_dir):
    """Statuses as a sidecar declares them against those found again (texts under 25 characters count as blank here)."""
    c = table(spark, sf_dir, "conversations").withColumn("declared", F.when(F.col("conv_id") % 6 == 0, "rejected").otherwise("accepted"))
    blank = F.when(F.length("text") < 25, F.lit("")).otherwise(F.col("text"))
    found = F.when(corpus.source_reason(blank, F.col("role")).isNotNull(), "rejected").otherwise("accepted")
    return c.withColumn("recomputed", found).where("declared <> recomputed").select("conv_id", "turn", "declared", "recomputed")


@query(f"SELECT doc_id, greatest(1, floor(duration * 24000 / 256))::BIGINT AS frames FROM ({UTT})")
def f09_frame_count(spark, sf_dir):
    return utterances(spark, sf_dir).select("doc_id", T.frames(F.col("duration")).alias("frames"))


@query(f"""WITH k AS (SELECT * FROM ({UTT}) WHERE duration BETWEEN 0.4 AND 30), v AS (SELECT lang, count(DISTINCT c) AS vocab_size FROM (SELECT lang, unnest(list_distinct(string_split(text, ''))) AS c FROM k WHERE length(text) > 0) GROUP BY 1)
  SELECT d.lang, coalesce(n_rows, 0) AS n_rows, hours, min_duration, max_duration, coalesce(vocab_size, 0) AS vocab_size, dropped
  FROM (SELECT lang, count(*) FILTER (WHERE NOT coalesce(duration BETWEEN 0.4 AND 30, false)) AS dropped FROM ({UTT}) GROUP BY lang) d LEFT JOIN v ON v.lang = d.lang
  LEFT JOIN (SELECT lang, count(*) AS n_rows, round(sum(duration) / 3600, 6) AS hours, round(min(duration), 6) AS min_duration, round(max(duration), 6) AS max_duration FROM k GROUP BY lang) s ON s.lang = d.lang""")
def a01_corpus_summary(spark, sf_dir):
    return corpus.full_summary(utterances(spark, sf_dir), ["lang"], F.col("duration").between(0.4, 30))


_VOCAB = "SELECT DISTINCT unnest(list_distinct(string_split(text, ''))) AS token FROM documents WHERE {where}"


@query(f"SELECT token, (row_number() OVER (ORDER BY CASE WHEN token = ' ' THEN 0 ELSE 1 END, token) - 1)::BIGINT AS idx FROM ({_VOCAB.format(where='length(text) > 0')})")
def a03_vocabulary(spark, sf_dir):
    return corpus.vocabulary(table(spark, sf_dir, "documents"))


@query(f"""SELECT token FROM ({_VOCAB.format(where='length(text) > 0')}) WHERE token <> chr(10) UNION SELECT chr(i::INT) FROM range(32, 127) t(i) UNION SELECT chr(i::INT) FROM range(192, 256) t(i)""")
def s12_vocabulary_sink(spark, sf_dir):
    """One token a line, sorted, with ASCII and Latin-1 letters; a line end cannot be a line, so it is left out."""
    path = scratch(spark)
    found = corpus.vocabulary(table(spark, sf_dir, "documents"), ascii_too=True)
    found.where(F.col("token") != "\n").orderBy("idx").select("token").write.text(path)
    return spark.read.text(path).withColumnRenamed("value", "token")


@query("SELECT source AS speaker, lang, count(*) AS n FROM documents GROUP BY ALL")
def a06_rows_per_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("speaker"), "lang").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(text, ''))) AS token FROM documents WHERE length(text) > 0),
  v AS (SELECT DISTINCT unnest(list_distinct(string_split(text, ''))) AS token FROM documents WHERE lang = 'en' AND length(text) > 0)
  SELECT token, count(*) AS n, min(doc_id) AS first_seen FROM t WHERE token NOT IN (SELECT token FROM v) GROUP BY token""")
def a15_out_of_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.out_of_vocabulary(docs, corpus.vocabulary(docs.where("lang = 'en'")), "doc_id")


@query(f"""WITH o AS (SELECT max(duration) m, sum(duration) total FROM ({UTT})), p AS (SELECT m, greatest(1, ceil(total * 93.75 / (38400 * 8))) AS per FROM o)
  SELECT ceil(greatest(m * 93.75, 38400.0))::BIGINT AS frame_budget, per::BIGINT AS updates_per_epoch, floor(1.2e6 / per)::BIGINT AS epochs, 60000::BIGINT AS warmup_updates FROM p""")
def a16_plan_estimate(spark, sf_dir):
    return corpus.plan_estimate(utterances(spark, sf_dir))


@query("SELECT 'documents' AS part, doc_id AS id, text FROM documents UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations")
def o01_corpus_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("part"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(table(spark, sf_dir, "conversations").select(F.lit("conversations").alias("part"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"))


_BY = "(SELECT token, (row_number() OVER (ORDER BY CASE WHEN token = ' ' THEN 0 ELSE 1 END, token) - 1)::BIGINT AS idx FROM ({}))"
_EN, _DE = (_BY.format(_VOCAB.format(where=f"lang = '{x}' AND length(text) > 0")) for x in ("en", "de"))


@query(f"SELECT * FROM {_EN} UNION ALL SELECT token, ((SELECT max(idx) FROM {_EN}) + row_number() OVER (ORDER BY token))::BIGINT FROM {_DE} WHERE token NOT IN (SELECT token FROM {_EN})")
def o04_vocabulary_extension(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.extended(written(corpus.vocabulary(docs.where("lang = 'en'"))), corpus.vocabulary(docs.where("lang = 'de'")))


@query(f"""SELECT t.token, t.idx + 1 AS target_row, s.idx + 1 AS source_row,
  CASE WHEN s.idx IS NULL THEN row_number() OVER (PARTITION BY s.idx IS NULL ORDER BY t.idx) END AS new_index FROM {_DE} t LEFT JOIN {_EN} s ON t.token = s.token""")
def j15_vocabulary_remap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return corpus.remap(corpus.vocabulary(docs.where("lang = 'de'")), corpus.vocabulary(docs.where("lang = 'en'")))
