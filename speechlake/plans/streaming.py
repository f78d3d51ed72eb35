"""Queries over streaming jobs: events as an arriving stream, run over all that has arrived."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import udf as U
from ..registry import query
from ..streaming import jobs
from ..tables import scratch, table
from .evaluation import LEGAL
from .text import ONE_BYTE


PARTS = 4


def _arriving(rows, key):
    """rows as a stream of ``PARTS`` batches in the order of key, each of as many files as there are shuffle partitions (64 at most)."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession)
    lo, hi = rows.agg(F.min(key), F.max(key)).first()
    files = min(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    part = F.least(F.floor((F.col(key) - lo) * PARTS / (hi - lo + 1)), F.lit(PARTS - 1))
    for k in range(PARTS):
        rows.where(part == k).repartition(files).write.mode("append").parquet(path)
    return jobs.stream_of(spark, path, rows.schema, files)


def arriving(spark, sf_dir):
    """events in four batches by event_id, which is their order in time."""
    return _arriving(table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "event_id")


#: The number of the batch that an event comes in.
_PART = f"least(floor((event_id - (SELECT min(event_id) FROM events)) * {PARTS} / ((SELECT max(event_id) - min(event_id) + 1 FROM events)))::BIGINT, {PARTS - 1})"


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1")
def r01_latest_status(spark, sf_dir):
    return jobs.finished(jobs.latest_status(arriving(spark, sf_dir), "user_id", "event_id", ["event_type"]), "update", ["user_id"])


_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in LEGAL)


@query(f"""SELECT user_id, count(s)::BIGINT AS steps, count(*) FILTER (WHERE s IS NOT NULL AND (s, event_type) NOT IN ({_PAIRS})) AS illegal, count(*) FILTER (WHERE event_type = 'signup') AS attempts, max_by(event_type, event_id) AS last
  FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS s FROM events) GROUP BY 1""")
def r02_chain_validator(spark, sf_dir):
    out = jobs.validate_chains(arriving(spark, sf_dir), "user_id", "event_id", "event_type", set(LEGAL), {"signup"})
    return jobs.finished(out, "update", ["user_id"])


@query("""WITH RECURSIVE e AS (SELECT event_id, user_id AS item, event_type AS owner, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
  g AS (SELECT item, i, event_id, owner, true AS granted, owner AS holder, t + 86400 AS expires FROM e WHERE i = 1
    UNION ALL SELECT e.item, e.i, e.event_id, e.owner, g.expires <= e.t OR g.holder = e.owner, CASE WHEN g.expires <= e.t OR g.holder = e.owner THEN e.owner ELSE g.holder END, CASE WHEN g.expires <= e.t OR g.holder = e.owner THEN e.t + 86400 ELSE g.expires END FROM g JOIN e ON e.item = g.item AND e.i = g.i + 1)
  SELECT item, event_id, owner, granted FROM g""")
def r03_leases(spark, sf_dir):
    """Events as requests for a user's lease, which lasts a day; the event's type is the owner that asks."""
    e = arriving(spark, sf_dir).withWatermark("ts", "1 hour")
    e = e.select(F.col("user_id").alias("item"), "event_id", F.col("event_type").alias("owner"), (F.unix_micros("ts") / 1e6).alias("at"), "ts")
    return jobs.finished(jobs.arbitrate_leases(e, "item", "event_id", "owner", "at", 86400.0, "ts"), "append")


#: Every fiftieth event is ten days late. Spark drops a row by the watermark of the batch before its own: the
#: latest time in the batches before that one, less the delay of two days.
_LATE = f"(SELECT event_type, CASE WHEN event_id % 50 = 0 THEN ts - INTERVAL 10 DAY ELSE ts END AS ts, {_PART} AS b FROM events)"
_MARK = f"(SELECT p.b, max(l.ts) - INTERVAL 2 DAY AS mark FROM (SELECT DISTINCT b FROM {_LATE}) p LEFT JOIN {_LATE} l ON l.b < p.b - 1 GROUP BY p.b)"


def _late(spark, sf_dir):
    ts = F.when(F.col("event_id") % 50 == 0, F.col("ts") - F.expr("INTERVAL 10 DAY")).otherwise(F.col("ts"))
    return arriving(spark, sf_dir).withColumn("ts", ts)


@query(f"""SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM {_LATE} JOIN {_MARK} USING (b)
  WHERE mark IS NULL OR date_trunc('day', ts) + INTERVAL 1 DAY > mark GROUP BY 1""")
def r04_interval_rates(spark, sf_dir):
    """Rates by day; what comes after its day's state is gone is dropped."""
    out = jobs.interval_rates(_late(spark, sf_dir), "ts", F.col("event_type") == "error", "1 day", "2 days")
    return jobs.finished(out, "update", ["start"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "failed")


@query(f"""SELECT start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failed FROM (SELECT *, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY])::TIMESTAMP AS start FROM {_LATE} JOIN {_MARK} USING (b))
  WHERE mark IS NULL OR start + INTERVAL 2 DAY > mark GROUP BY 1""")
def r04_sliding_rates(spark, sf_dir):
    """The same by two days, moving by one."""
    out = jobs.interval_rates(_late(spark, sf_dir), "ts", F.col("event_type") == "error", "2 days", "2 days", "1 day")
    return jobs.finished(out, "update", ["start"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "failed")


@query("""SELECT sha256(lower(substr(text, 1, 40))) AS audio_sha256, md5(text) AS text_md5, min(lang || '#' || lpad(doc_id::VARCHAR, 12, '0')) AS kept, count(*)::BIGINT AS n,
  count(DISTINCT text) OVER (PARTITION BY sha256(lower(substr(text, 1, 40)))) > 1 AS conflict FROM documents GROUP BY sha256(lower(substr(text, 1, 40))), text""")
def r05_incremental_dedup(spark, sf_dir):
    """Packages arrive in four waves: winners and conflicts after the last one equal those of all rows."""
    d = table(spark, sf_dir, "documents").select(F.sha2(F.lower(F.substring("text", 1, 40)), 256).alias("audio_sha256"), F.md5("text").alias("text_md5"), "lang", "doc_id")
    w = jobs.merged_winners(_arriving(d, "doc_id"), ["audio_sha256", "text_md5"], ["lang", "doc_id"])
    texts = w.groupBy("audio_sha256").agg((F.count("*") > 1).alias("conflict"))
    return w.join(texts, "audio_sha256").select("audio_sha256", "text_md5", F.concat("winner.lang", F.lit("#"), F.lpad(F.col("winner.doc_id").cast("string"), 12, "0")).alias("kept"), "n", "conflict")


@query("SELECT DISTINCT user_id, event_type FROM events")
def r05_first_copies(spark, sf_dir):
    """Exact copies within a watermark that spans the table; the state is carried over four batches."""
    out = jobs.first_copies(arriving(spark, sf_dir), "ts", ["user_id", "event_type"], "60 days")
    return jobs.finished(out.select("user_id", "event_type"), "append")


@query("""WITH s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
  SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 3600000000 THEN 1 ELSE 0 END AS n FROM events))
  SELECT user_id, session, count(*) AS n FROM s GROUP BY ALL HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def r06_activity_sessions(spark, sf_dir):
    """Sessions that the watermark (two hours behind) has closed, numbered from 0 for each user; their state is gone."""
    from pyspark.sql import Window as W

    out = jobs.finished(jobs.activity_sessions(arriving(spark, sf_dir).select("user_id", "ts"), "ts", "user_id", "1 hour", "2 hours"), "append")
    w = W.partitionBy("user_id").orderBy("start")
    return out.select("user_id", (F.row_number().over(w) - 1).cast("long").alias("session"), "n")


@query("SELECT event_id FROM events e JOIN (SELECT event_type, avg(value) AS expected FROM events GROUP BY 1) r USING (event_type) WHERE abs(value - expected) > 25")
def r07_live_trace(spark, sf_dir):
    ref = table(spark, sf_dir, "events").groupBy("event_type").agg(F.avg("value").alias("expected"))
    out = jobs.off_trace(arriving(spark, sf_dir), ref, "event_type", "value", "expected", 25.0)
    return jobs.finished(out.select("event_id"), "append")


@query(f"SELECT conv_id, turn, round(levenshtein({ONE_BYTE.format('text')}, {ONE_BYTE.format('lower(text)')}) / length(text), 6) AS cer FROM conversations WHERE length(text) > 0")
def u03_scored_once(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.col("text").alias("a"), F.lower("text").alias("b"))
    return U.scored_once(rows, "a", "b", ["cer"]).select("conv_id", "turn", F.round("cer", 6).alias("cer"))


@query("SELECT conv_id, turn, strlen(text)::BIGINT AS n_bytes, length(text) AS n_chars FROM conversations WHERE length(text) > 0")
def u01_tokenizer_registry(spark, sf_dir):
    """Two tokenizers by name, and one that a caller adds."""
    U.TOKENIZERS["spaced"] = lambda c: F.split(c, " ")
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", *[U.tokenizer(n)(F.col("text")).alias(n) for n in ("byte", "char", "spaced")])
    same = F.size("char") == F.length(F.array_join("spaced", " "))
    return rows.where(same).select("conv_id", "turn", F.size("byte").cast("long").alias("n_bytes"), F.size("char").cast("long").alias("n_chars"))


@query("SELECT l_orderkey, l_linenumber, round(0.25 * l_quantity - 2 * l_discount + 1, 6) AS score FROM lineitem")
def u06_model_slot(spark, sf_dir):
    """A linear model, made once for each partition."""

    def make():
        weights = (0.25, -2.0, 1.0)
        return lambda pdf: pdf[["l_orderkey", "l_linenumber"]].assign(score=(weights[0] * pdf["l_quantity"].astype(float) + weights[1] * pdf["l_discount"].astype(float) + weights[2]).round(6))

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return U.with_model(rows, f"l_orderkey {kinds['l_orderkey']}, l_linenumber {kinds['l_linenumber']}, score double", make)


@query(r"""WITH s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(regexp_replace(text, '([;:,.!?])\s+', '\1' || chr(1), 'g'), '([；：，。！？])', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM conversations),
  p AS (SELECT conv_id, turn, list_reduce(list_prepend([''], list_transform(s, lambda x: [x || CASE WHEN strlen(right(x, 1)) = 1 THEN ' ' ELSE '' END, x])),
    lambda a, x: CASE WHEN a[-1] <> '' AND strlen(a[-1]) + strlen(x[2]) > 60 THEN list_append(a, x[1]) ELSE list_append(a[:-2], a[-1] || x[1]) END) AS p FROM s),
  c AS (SELECT conv_id, turn, unnest(range(0, len(p))) AS chunk, unnest(p) AS text FROM p)
  SELECT conv_id, turn, chunk::INT AS chunk, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM c WHERE text <> ''""")
def u05_sentence_chunks_udtf(spark, sf_dir):
    """Sentences packed from the left; the SQL packs them by a fold over the list."""
    U.register(spark)
    table(spark, sf_dir, "conversations").createOrReplaceTempView("_sl_conversations")
    return spark.sql("SELECT c.conv_id, c.turn, s.chunk, s.text FROM _sl_conversations c, LATERAL sentence_chunks(c.text, 60) s")


@query("SELECT l_orderkey, l_linenumber, round(l_discount * l_discount, 6) AS weight FROM lineitem")
def u02_custom_schedule(spark, sf_dir):
    square = U.scheduled(lambda x: x * x)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(square(F.col("l_discount").cast("double")), 6).alias("weight"))
