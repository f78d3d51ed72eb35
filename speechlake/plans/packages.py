"""Queries over package, aggregation and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectorized as V
from ..operators import aggregate, packages
from ..registry import query
from ..sources import readers, sinks
from ..tables import scratch, table

UTT = "(SELECT sha256(lower(substr(text, 1, 40))) AS audio_sha256, text, source AS speaker, n_chars / 15.0 AS duration, lang, doc_id FROM documents)"


def utterances(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select(F.sha2(F.lower(F.substring("text", 1, 40)), 256).alias("audio_sha256"), "text", F.col("source").alias("speaker"), (F.col("n_chars") / 15).alias("duration"), "lang", "doc_id")


ORDER = ["lang", "doc_id"]


def _plain(spark, sf_dir):
    """Whole texts as one line each: line ends and separators become spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", F.trim(F.translate("text", "\r\n\t|\"\\", "      ")).alias("t")).where("t <> ''")


_PLAIN = "(SELECT doc_id, trim(translate(text, chr(13) || chr(10) || chr(9) || '|\"\\', '      ')) AS t FROM documents)"


@query(f"SELECT '/audio/' || doc_id || '.wav' AS audio_file, t AS text FROM {_PLAIN} WHERE t <> ''")
def s01_piped_manifest(spark, sf_dir):
    path = scratch(spark)
    rows = _plain(spark, sf_dir).select(F.concat(F.lit("/audio/"), "doc_id", F.lit(".wav|"), "t").alias("value"))
    parts = rows.withColumn("p", F.pmod(F.xxhash64("value"), F.lit(16)))
    # Each file starts with its header line.
    heads = parts.select("p").distinct().select(F.lit("audio_file|text").alias("value"), "p", F.lit(0).alias("o"))
    parts.withColumn("o", F.lit(1)).unionByName(heads).repartition("p").sortWithinPartitions("p", "o", "value").select("value", "p").write.partitionBy("p").text(path)
    return readers.piped_manifest(spark, f"{path}/*").where("reason is null").select("audio_file", "text")


@query(f"SELECT 'wavs/' || doc_id || '.wav' AS wav, t AS text, lower(t) AS norm_text FROM {_PLAIN} WHERE t <> ''")
def s02_three_columns(spark, sf_dir):
    path = scratch(spark)
    _plain(spark, sf_dir).select(F.concat_ws("|", F.col("doc_id").cast("string"), "t", F.lower("t"))).write.text(path)
    return readers.three_columns(spark, path)


@query("SELECT user_id, event_id, event_type, value FROM events")
def s07_json_log(spark, sf_dir):
    path = scratch(spark)
    table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value").write.json(path)
    return readers.json_log(spark, path, "user_id long, event_id long, event_type string, value double")


@query("""SELECT line, user_id, event_id, event_type, reason FROM (SELECT row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) AS line, event_id % 97 = 0 AS bad,
  CASE WHEN NOT bad THEN user_id END AS user_id, CASE WHEN NOT bad THEN event_id END AS event_id, CASE WHEN NOT bad THEN event_type END AS event_type, CASE WHEN bad THEN 'malformed' END AS reason FROM events)""")
def s07_bad_lines(spark, sf_dir):
    """Eight logs in the order of their events; every 97th event's line was cut off as it was written."""
    path = scratch(spark)
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    line = F.to_json(F.struct("user_id", "event_id", "event_type"))
    lines = e.select(F.when(F.col("event_id") % 97 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value"), (F.col("event_id") % 8).alias("p"), "event_id")
    lines.repartition("p").sortWithinPartitions("p", "event_id").select("value", "p").write.partitionBy("p").text(path)
    log = readers.checked_log(spark, f"{path}/*", "user_id long, event_id long, event_type string")
    whole = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in ("user_id", "event_id", "event_type")]
    return log.select(F.col("line").cast("long").alias("line"), *whole, "reason")


@query(f"""SELECT doc_id || '-1-0' AS ref_utt, 1.5::DOUBLE AS ref_dur, t AS ref_txt, doc_id || '-2-0' AS gen_utt, (doc_id % 10)::DOUBLE AS gen_dur, '= ' || t AS gen_txt,
  '/base/' || doc_id || '/1/' || doc_id || '-1-0.flac' AS ref_wav, '/base/' || doc_id || '/2/' || doc_id || '-2-0.flac' AS gen_wav FROM {_PLAIN} WHERE t <> ''""")
def s06_tabbed_list(spark, sf_dir):
    path, d = scratch(spark), F.col("doc_id").cast("string")
    fields = [F.concat(d, F.lit("-1-0")), F.lit("1.5"), F.col("t"), F.concat(d, F.lit("-2-0")), (F.col("doc_id") % 10).cast("string"), F.concat(F.lit("= "), "t")]
    _plain(spark, sf_dir).where("t <> ''").select(F.concat_ws("\t", *fields)).write.text(path)
    return readers.tabbed_eval_list(spark, path, "/base")


@query(f"SELECT doc_id::VARCHAR AS utt, t AS prompt_text, '/base/p' || doc_id || '.wav' AS prompt_wav, '= ' || t AS gt_text, '/base/wavs/' || doc_id || '.wav' AS gt_wav FROM {_PLAIN} WHERE t <> ''")
def s06_eval_list(spark, sf_dir):
    path = scratch(spark)
    _plain(spark, sf_dir).select(F.concat_ws("|", F.col("doc_id").cast("string"), "t", F.concat(F.lit("p"), "doc_id", F.lit(".wav")), F.concat(F.lit("= "), "t"))).write.text(path)
    return readers.piped_eval_list(spark, path, "/base")


@query("SELECT 'section ' || n_name AS section, c_custkey::VARCHAR AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def s08_markdown_catalog(spark, sf_dir):
    """Customers written as one Markdown table for each nation, read back with their headings."""
    path = scratch(spark)
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select(F.concat(F.lit("| "), "c_custkey", F.lit(" | "), "c_name", F.lit(" |")).alias("value"), "n_nationkey", F.lit(2).alias("o"))
    heads = c.select("n_nationkey", "n_name").distinct().select("n_nationkey", F.explode(F.array(F.struct(F.concat(F.lit("# section "), "n_name").alias("value"), F.lit(0).alias("o")), F.struct(F.lit("| id | name |\n|---|---|").alias("value"), F.lit(1).alias("o")))).alias("h"))
    rows.unionByName(heads.select("h.value", "n_nationkey", "h.o")).repartition("n_nationkey").sortWithinPartitions("n_nationkey", "o", "value").select("value", "n_nationkey").write.partitionBy("n_nationkey").text(path)
    return readers.catalog(spark, f"{path}/*", ["id", "name"]).where("reason is null").select("section", "id", "name")


@query("SELECT url AS path, (page_id + 7)::BIGINT AS size, md5(url) AS blob_id, sha256(url) AS sha256 FROM pages")
def s09_api_listing(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    odd = F.to_json(F.struct(F.col("url").alias("rfilename"), F.md5("url").alias("blobId"), F.lit(1).alias("size"), F.struct((F.col("page_id") + 7).alias("size"), F.sha2("url", 256).alias("oid")).alias("lfs")))
    even = F.to_json(F.struct(F.col("url").alias("path"), F.md5("url").alias("oid"), (F.col("page_id") + 7).alias("size"), F.struct(F.sha2("url", 256).alias("sha256")).alias("lfs")))
    return p.select(F.when(F.col("page_id") % 2 == 1, odd).otherwise(even).alias("j")).select(*readers.api_files(F.col("j")))


@query("SELECT url AS path, (CASE WHEN page_id % 4 = 0 THEN 'digest;' ELSE '' END) || (CASE WHEN page_id % 9 = 0 THEN 'blob;' ELSE '' END) || (CASE WHEN page_id % 10 = 0 THEN 'size;' ELSE '' END) AS broken FROM pages")
def s09_file_identities(spark, sf_dir):
    """Listings with ill-formed identities: every fourth digest is cut, every ninth blob id is in capitals, every tenth
    size is negative."""
    i = F.col("page_id")
    j = F.to_json(F.struct(F.col("url").alias("path"), F.when(i % 9 == 0, F.upper(F.concat(F.lit("a"), F.sha1("url")))).otherwise(F.sha1("url")).alias("oid"), F.when(i % 10 == 0, -i - 1).otherwise(i).alias("size"), F.struct(F.when(i % 4 == 0, F.substring(F.sha2("url", 256), 1, 63)).otherwise(F.sha2("url", 256)).alias("sha256")).alias("lfs")))
    files = table(spark, sf_dir, "pages").select(j.alias("j")).select(*readers.api_files(F.col("j")))
    return files.select("path", F.array_join(F.transform(readers.file_faults(), lambda f: F.concat(f, F.lit(";"))), "").alias("broken"))


@query("""SELECT conv_id, conv_id % 5 <> 0 AS count_ok, conv_id % 7 <> 0 OR count(*) OVER (PARTITION BY conv_id) = 1 AS unique_ids, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS row_index, role, text, conv_id % 3 <> 0 AS text_ok FROM conversations""")
def s10_open_package(spark, sf_dir):
    """Conversations nested into one document each, written as JSON and opened again. Every fifth one declares a wrong
    count, every seventh has one id for all its turns, every third the digests of other texts."""
    path = scratch(spark)
    c = table(spark, sf_dir, "conversations")
    digest = F.sha2(F.when(F.col("conv_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256)
    ident = F.concat("conv_id", F.lit("-"), F.when(F.col("conv_id") % 7 == 0, F.lit(0)).otherwise(F.col("turn")))
    docs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", digest.alias("text_sha256"), ident.alias("id")))).alias("samples"), F.count("*").alias("record_count"))
    docs.withColumn("record_count", F.col("record_count") + (F.col("conv_id") % 5 == 0).cast("long")).write.json(path)
    back = readers.nested_documents(spark, path, "conv_id long, samples array<struct<turn: long, role: string, text: string, text_sha256: string, id: string>>, record_count long")
    rows = packages.opened(back, "samples", "record_count", ["conv_id"], "id", "text", "text_sha256")
    return rows.select("conv_id", "count_ok", "unique_ids", F.col("row_index").cast("int").alias("row_index"), "role", "text", "text_ok")


@query("SELECT floor((row_number() OVER (ORDER BY doc_id) - 1) / 128)::BIGINT AS shard_id, count(*) OVER () AS n_total, doc_id FROM documents")
def w04_shard_assignment(spark, sf_dir):
    rows = aggregate.shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 128)
    total = rows.agg(F.count("*").alias("n_total"))
    return rows.join(F.broadcast(total)).select("shard_id", "n_total", "doc_id")


_ROWHASH = "sha256(doc_id::VARCHAR || chr(31) || lang || chr(31) || source)"


@query(f"""SELECT shard_id, count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, floor((row_number() OVER (ORDER BY doc_id) - 1) / 100)::BIGINT AS shard_id, {_ROWHASH} AS h FROM documents) GROUP BY shard_id""")
def s11_sharded_sink(spark, sf_dir):
    return sinks.write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), scratch(spark), ["doc_id"], 100)


@query(f"""SELECT floor(p / 100)::BIGINT AS shard_id, count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY p)) AS digest, true AS read_back FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, {_ROWHASH} AS h FROM documents) GROUP BY 1""")
def s11_publish(spark, sf_dir):
    """Published twice: the second time finds equal digests. The rows read back through the marker fit the manifest."""
    rows, path = table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), scratch(spark)
    sinks.publish(rows, path, ["doc_id"], 100)
    found = sinks.publish(rows, path, ["doc_id"], 100)
    per = sinks.published(spark, path)[0].groupBy(F.col("shard_id").alias("_s")).agg(F.count("*").alias("_n"))
    return found.join(per, F.col("shard_id") == F.col("_s"), "left").select("shard_id", "n_rows", "digest", F.coalesce(F.col("n_rows") == F.col("_n"), F.lit(False)).alias("read_back"))


@query(f"""WITH RECURSIVE m AS (SELECT floor(p / 10)::BIGINT AS node, count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM (
    SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, {_ROWHASH} AS h FROM documents) GROUP BY 1),
  t AS (SELECT 0 AS level, node, n_rows::BIGINT AS n_rows, digest FROM m
    UNION ALL SELECT level + 1, node // 16, sum(n_rows)::BIGINT, sha256(string_agg(digest, '' ORDER BY node)) FROM t WHERE (SELECT max(node) FROM m) >> (4 * level) > 0 GROUP BY level, node // 16)
  SELECT * FROM t""")
def a17_merkle(spark, sf_dir):
    """The tree of digests over shards of ten rows, sixteen to a node."""
    sharded = aggregate.shards(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["doc_id"], 10)
    digest = F.sha2(F.concat_ws("\x1f", F.col("doc_id").cast("string"), "lang", "source"), 256)
    return aggregate.merkle(aggregate.manifest(sharded.select("shard_id", "position", digest.alias("row_digest")), "row_digest"))


@query(f"""WITH m AS (SELECT shard_id, count(*) AS n_rows, sha256(string_agg(h, '' ORDER BY p)) AS digest FROM (
  SELECT row_number() OVER (ORDER BY doc_id) - 1 AS p, floor((row_number() OVER (ORDER BY doc_id) - 1) / 100)::BIGINT AS shard_id, {_ROWHASH} AS h FROM documents) GROUP BY shard_id)
  SELECT count(*) AS n_shards, sum(n_rows)::BIGINT AS n_rows, sha256(string_agg(digest, '' ORDER BY shard_id)) AS digest FROM m""")
def a17_table_fingerprint(spark, sf_dir):
    return aggregate.tree_digest(sinks.write_shards(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), scratch(spark), ["doc_id"], 100))


@query("""SELECT c_custkey, sha256('{"address":' || to_json(c_name)::VARCHAR || ',"key":' || c_custkey || ',"nation":' || c_nationkey || '}') AS fingerprint FROM customer""")
def a17_row_fingerprint(spark, sf_dir):
    """sha256 of each row's canonical JSON: keys sorted, no spaces."""
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", aggregate.row_fingerprint(address=F.col("c_name"), key=F.col("c_custkey"), nation=F.col("c_nationkey")).alias("fingerprint"))


@query("""SELECT count(*) AS n_tokens, sha256(unhex(string_agg(lpad(to_hex(strlen(token)), 16, '0') || hex(token), '' ORDER BY CASE WHEN token = ' ' THEN 0 ELSE 1 END, token))) AS digest
  FROM (SELECT DISTINCT unnest(string_split(text, '')) AS token FROM documents WHERE length(text) > 0)""")
def a17_token_digest(spark, sf_dir):
    from ..operators import corpus

    return aggregate.token_digest(corpus.vocabulary(table(spark, sf_dir, "documents")))


@query(f"SELECT audio_sha256, md5(text) AS text_md5, min(lang || '#' || lpad(doc_id::VARCHAR, 12, '0')) AS kept, count(*) AS n FROM {UTT} GROUP BY audio_sha256, text")
def a04_dedup_winner(spark, sf_dir):
    keyed = utterances(spark, sf_dir).withColumn("text_md5", F.md5("text"))
    w = aggregate.winners(keyed, ["audio_sha256", "text_md5"], ORDER)
    return w.select("audio_sha256", "text_md5", F.concat("winner.lang", F.lit("#"), F.lpad(F.col("winner.doc_id").cast("string"), 12, "0")).alias("kept"), "n")


@query(f"SELECT doc_id, kept_id FROM (SELECT doc_id, first_value(doc_id) OVER w AS kept_id FROM {UTT} WINDOW w AS (PARTITION BY audio_sha256, text ORDER BY lang, doc_id)) WHERE doc_id <> kept_id")
def a04_excluded_duplicates(spark, sf_dir):
    return aggregate.duplicates(aggregate.text_keyed(utterances(spark, sf_dir), ORDER), ["audio_sha256", "text_sha256"], ORDER).select("doc_id", F.col("winner.doc_id").alias("kept_id"))


@query(f"""SELECT audio_sha256, sha256(text) AS text_sha256, min(lang || '#' || lpad(doc_id::VARCHAR, 12, '0')) AS first, count(*) AS n_rows, any_value(n) AS n_texts
  FROM {UTT} JOIN (SELECT audio_sha256, count(DISTINCT text) AS n FROM {UTT} GROUP BY 1) USING (audio_sha256) WHERE n > 1 GROUP BY audio_sha256, text""")
def a05_conflicts(spark, sf_dir):
    c = aggregate.conflict_rows(aggregate.text_keyed(utterances(spark, sf_dir), ORDER), ORDER)
    return c.select("audio_sha256", "text_sha256", F.concat("first.lang", F.lit("#"), F.lpad(F.col("first.doc_id").cast("string"), 12, "0")).alias("first"), "n_rows", "n_texts")


_KEPT = f"""(SELECT audio_sha256, text, min(lang || '#' || lpad(doc_id::VARCHAR, 12, '0')) AS w FROM {UTT} WHERE audio_sha256 IN (SELECT audio_sha256 FROM {UTT} GROUP BY 1 HAVING count(DISTINCT text) = 1) GROUP BY audio_sha256, text)"""


@query(f"SELECT audio_sha256, md5(text) AS text_md5, w AS kept FROM {_KEPT}")
def k01_canonical_rows(spark, sf_dir):
    keyed = utterances(spark, sf_dir).withColumn("text_md5", F.md5("text"))
    kept = aggregate.kept_rows(aggregate.text_keyed(keyed, [*ORDER, "text_md5"]), [*ORDER, "text_md5"])
    # Of conflict-free digests each has one text, so the digest alone gives the order.
    return kept.orderBy("audio_sha256").select("audio_sha256", "text_md5", F.concat("lang", F.lit("#"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("kept"))


_SPLIT = f"""(WITH u AS (SELECT k.audio_sha256, k.text, d.speaker, d.duration, sha256('["' || k.audio_sha256 || '","' || sha256(k.text) || '"]') AS rank
    FROM {_KEPT} k JOIN {UTT} d ON k.w = d.lang || '#' || lpad(d.doc_id::VARCHAR, 12, '0')),
  e AS (SELECT rank FROM u QUALIFY rank <> max(rank) OVER (PARTITION BY speaker) ORDER BY rank LIMIT 50)
  SELECT u.*, CASE WHEN e.rank IS NULL THEN 'train' ELSE 'eval' END AS split FROM u LEFT JOIN e ON u.rank = e.rank)"""


def _split(spark, sf_dir):
    order = [*ORDER, "speaker", "duration"]
    kept = aggregate.kept_rows(aggregate.text_keyed(utterances(spark, sf_dir), order), order)
    rank = F.sha2(F.concat(F.lit('["'), "audio_sha256", F.lit('","'), "text_sha256", F.lit('"]')), 256)
    return aggregate.holdout(kept.withColumn("rank", rank), "speaker", "rank", 50)


@query(f"SELECT audio_sha256, split FROM {_SPLIT}")
def w01_holdout_split(spark, sf_dir):
    return _split(spark, sf_dir).select("audio_sha256", "split")


@query(f"SELECT split, count(*) AS n_rows, count(DISTINCT speaker) AS speakers, round(sum(duration) / 3600, 6) AS hours FROM {_SPLIT} GROUP BY split")
def package_aggregation(spark, sf_dir):
    """The flagship: utterances, dedup winner, conflict exclusion, hold-out split, summary by split."""
    return _split(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n_rows"), F.countDistinct("speaker").alias("speakers"), F.round(F.sum("duration") / 3600, 6).alias("hours"))


@query("SELECT o_orderpriority AS wave, count(*) AS n FROM orders WHERE o_orderpriority <= '2-HIGH' AND o_orderkey % 7 = 0 GROUP BY 1")
def a18_wave_coverage(spark, sf_dir):
    """Orders as selected items of waves; every seventh is not among the inputs."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("wave"))
    gaps = aggregate.wave_coverage(o, o.where("id % 7 <> 0 and wave <= '2-HIGH'"), "2-HIGH")
    return gaps.where("side = 'missing'").join(o, "id").groupBy("wave").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, coalesce(d.n, 0) AS n_left, coalesce(l.n, 0) AS n_right,
  CASE WHEN coalesce(l.n, 0) = 0 THEN 'missing' WHEN coalesce(d.n, 0) = 0 THEN 'extra' WHEN d.n > 1 OR l.n > 1 THEN 'repeated' ELSE 'matched' END AS verdict
  FROM (SELECT doc_id, count(*) AS n FROM documents GROUP BY 1) d FULL JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l ON d.doc_id = l.doc_id""")
def j01_strict_reconcile(spark, sf_dir):
    return packages.reconcile(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("""SELECT lower(s_name) AS key, coalesce(b, a) AS path, CASE WHEN a <> b THEN a END AS indexed_as,
  CASE WHEN b IS NULL THEN 'missing' WHEN a IS NULL THEN 'unindexed' ELSE 'matched' END AS verdict FROM (
  SELECT coalesce(x.k, y.k) AS s_name, x.p AS a, y.p AS b FROM (SELECT lower(s_name) k, upper(s_name) p FROM supplier WHERE s_suppkey % 5 <> 0) x
  FULL JOIN (SELECT lower(s_name) k, s_name p FROM supplier WHERE s_suppkey % 3 <> 0) y ON x.k = y.k)""")
def j02_portable_key_join(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    indexed, inventory = s.where("s_suppkey % 5 <> 0").select(F.upper("s_name").alias("p")), s.where("s_suppkey % 3 <> 0").select(F.col("s_name").alias("p"))
    return packages.by_portable_key(indexed, inventory, "p", V.portable_key)


@query("""SELECT o_orderkey, o_custkey <> c AS differs FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS c FROM orders) WHERE o_custkey <> c""")
def j03_equality_join(spark, sf_dir):
    """Orders against a sidecar in which every eleventh customer differs."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    side = o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 11 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey")))
    return packages.mismatches(o, side, ["o_orderkey"], ["o_custkey", "o_orderstatus"]).select("o_orderkey", F.array_contains("fields", "o_custkey").alias("differs"))


@query("SELECT d.doc_id, coalesce(l.quality, -1)::BIGINT AS quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j04_enrich_with_fallback(spark, sf_dir):
    rows = packages.enriched(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id", "quality", F.lit(-1), "quality")
    return rows.select("doc_id", F.col("quality").cast("long").alias("quality"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 10 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 = 0)")
def j05_exclusion(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return packages.excluded(o, o.where("o_orderkey % 10 = 0"), ["o_orderkey", "o_custkey"]).select("o_orderkey")


@query("""SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' WHEN p_size < 51 THEN 'large' END AS stratum, 1::BIGINT AS strata, count(*) AS n FROM part GROUP BY 1, 2""")
def j06_stratum_join(spark, sf_dir):
    name, strata = packages.stratum(F.col("p_size"), [("small", 0, 10), ("medium", 10, 30), ("large", 30, 51)])
    return table(spark, sf_dir, "part").groupBy(name.alias("stratum"), strata.cast("long").alias("strata")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT l_orderkey, count(*) AS n, md5(l_orderkey::VARCHAR) AS d FROM lineitem GROUP BY 1) SELECT o_orderkey,
  CASE WHEN n IS NULL THEN 'no_artifact' WHEN n <> 4 THEN 'size' WHEN o_orderkey % 6 = 0 THEN 'digest' ELSE 'ready' END AS verdict FROM orders LEFT JOIN a ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def j12_item_plan(spark, sf_dir):
    """Eligible orders as items that declare four lines and a digest (every sixth a wrong one); line items as artifacts."""
    a = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("size")).withColumn("digest", F.md5(F.col("o_orderkey").cast("string")))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.lit(4).cast("long").alias("size"), F.md5(F.concat(F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 6 == 0, F.lit("x")).otherwise(F.lit("")))).alias("digest"))
    return packages.artifact_plan(o, a, "o_orderkey")


@query("SELECT o_custkey AS key, 'unregistered' AS verdict FROM (SELECT DISTINCT o_custkey FROM orders) WHERE o_custkey % 4 = 0 UNION ALL SELECT c_custkey, 'unused' FROM customer WHERE c_custkey % 4 <> 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def j13_registry_coverage(spark, sf_dir):
    used = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"))
    return packages.registry_coverage(used, table(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("key")), "key")


@query("""SELECT page_id, (CASE WHEN NOT regexp_full_match(url, 'https?://[a-z0-9.-]+(/.*)?') THEN 'scheme;' ELSE '' END) || (CASE WHEN contains(url, '#') THEN 'fragment;' ELSE '' END) || (CASE WHEN contains(url, '?') THEN 'query;' ELSE '' END) AS broken FROM pages""")
def f07_violations(spark, sf_dir):
    found = packages.violations(("scheme;", ~F.col("url").rlike(r"^https?://[a-z0-9.-]+(/.*)?$")), ("fragment;", F.contains("url", F.lit("#"))), ("query;", F.contains("url", F.lit("?"))))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, "").alias("broken"))


@query("""WITH p AS (SELECT page_id, 'd' || (page_id % 17) || CASE WHEN page_id % 2 = 0 THEN '/a' || page_id ELSE '/B' || page_id || '.OGG' END AS path FROM pages)
  SELECT page_id, CASE WHEN contains(path, '.') THEN '/base/' || path ELSE '/base/' || path || CASE WHEN page_id % 4 = 0 THEN '.ogg' ELSE '.wav' END END AS resolved FROM p""")
def f10_path_resolution(spark, sf_dir):
    """Made-up file names for pages; every fourth one exists as .ogg (and .mp3)."""
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("/a"), "page_id")).otherwise(F.concat(F.lit("/B"), "page_id", F.lit(".OGG")))
    p = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("d"), F.col("page_id") % 17, name).alias("path"))
    there = p.where("page_id % 4 = 0").select(F.explode(F.array(F.concat("path", F.lit(".mp3")), F.concat("path", F.lit(".ogg")))).alias("name"))
    return packages.resolved(p, there, "/base", ["wav", "ogg", "mp3"]).select("page_id", "resolved")


_MEMBERS = """(SELECT regexp_extract(url, '://([^/?#]*)', 1) AS archive, CASE WHEN page_id % 11 = 0 THEN 'other' ELSE 'root' END || '/' || CASE WHEN page_id % 3 = 0 THEN 'VOICE' WHEN page_id % 5 = 0 THEN 'voice/a.ogg' ELSE 'f' || page_id || '.ogg' END AS path,
  strlen(html) AS size, CASE WHEN page_id % 19 = 0 THEN 1 ELSE strlen(html) END AS packed FROM pages)"""


def _members(spark, sf_dir):
    """Pages as archive members, their hosts as archives. Some lie outside the root, some share a name but for its
    case, some are a file where others have a folder, some are packed to a byte."""
    i = F.col("page_id")
    name = F.when(i % 3 == 0, F.lit("VOICE")).when(i % 5 == 0, F.lit("voice/a.ogg")).otherwise(F.concat(F.lit("f"), i, F.lit(".ogg")))
    path = F.concat(F.when(i % 11 == 0, F.lit("other/")).otherwise(F.lit("root/")), name)
    size = F.octet_length("html").cast("long")
    m = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "://([^/?#]*)", 1).alias("archive"), path.alias("path"), size.alias("size"), F.when(i % 19 == 0, F.lit(1)).otherwise(size).cast("long").alias("packed"))
    return m.withColumn("folded", V.portable_key("path"))


@query(f"""SELECT archive, count(*) AS n, sum(size)::BIGINT AS total, (CASE WHEN max(size) > 4000 THEN 'member_size;' ELSE '' END) || (CASE WHEN sum(size) > 60000 THEN 'total_size;' ELSE '' END) || (CASE WHEN sum(size) > sum(packed) * 1.05 THEN 'ratio;' ELSE '' END)
  || (CASE WHEN count(*) > 20 THEN 'members;' ELSE '' END) || (CASE WHEN count(DISTINCT split_part(path, '/', 1)) > 1 THEN 'roots;' ELSE '' END) || (CASE WHEN count(DISTINCT lower(path)) < count(*) THEN 'repeated_name;' ELSE '' END) AS broken FROM {_MEMBERS} GROUP BY archive""")
def f11_archive_limits(spark, sf_dir):
    out = packages.archive_limits(_members(spark, sf_dir), 4000, 60000, 1.05, 20)
    return out.select("archive", "n", F.col("total").cast("long").alias("total"), F.concat(F.array_join("violations", ";"), F.when(F.size("violations") > 0, ";").otherwise("")).alias("broken"))


@query(f"SELECT archive, path FROM {_MEMBERS} m WHERE path LIKE '%/VOICE' AND EXISTS (SELECT 1 FROM {_MEMBERS} o WHERE o.archive = m.archive AND o.path = lower(m.path) || '/a.ogg')")
def f11_prefix_conflicts(spark, sf_dir):
    return packages.prefix_conflicts(_members(spark, sf_dir))


@query("""SELECT c_custkey, (CASE WHEN c_custkey % 5 = 0 THEN 'digest;' ELSE '' END) || (CASE WHEN c_custkey % 7 = 0 THEN 'id;' ELSE '' END) || (CASE WHEN c_custkey % 4 = 0 THEN 'path;' ELSE '' END) || (CASE WHEN c_custkey % 9 = 0 THEN 'size;' ELSE '' END) AS broken FROM customer""")
def f07_identity_rules(spark, sf_dir):
    """Customers as catalog items with made-up faults."""
    k, sha = F.col("c_custkey"), F.sha2(F.col("c_custkey").cast("string"), 256)
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 5 == 0, F.substring(sha, 1, 50)).otherwise(F.when(k % 2 == 0, F.substring(sha, 1, 40)).otherwise(sha)).alias("sha"), F.concat(F.when(k % 7 == 0, F.lit("sel_")).otherwise(F.lit("item_")), F.substring(sha, 1, 24)).alias("ident"), F.when(k % 8 == 0, F.lit("a/../b")).when(k % 4 == 0, F.lit("one")).otherwise(F.lit("pack/one.7z")).alias("path"), F.when(k % 9 == 0, F.lit(0)).otherwise(k).alias("size"))
    rules = packages.identity_rules(F.col("sha"), F.col("ident"), "item_", F.col("path"), F.col("size"))
    return c.select("c_custkey", F.array_join(F.transform(packages.violations(*rules), lambda r: F.concat(r, F.lit(";"))), "").alias("broken"))


@query("""SELECT o_orderkey, CASE WHEN l < greatest(1000, 0.05 * 2e6) THEN 'hard' WHEN l < greatest(2e5, 0.12 * 2e6) THEN 'soft' ELSE 'normal' END AS class FROM (
  SELECT o_orderkey, 2e6 - sum(o_totalprice * 8) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS l FROM orders)""")
def f12_disk_admission(spark, sf_dir):
    """One disk for each customer; orders are admitted in order."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    soft, hard = packages.watermarks(2e6, (2e5, 0.12), (1e3, 0.05))
    return packages.disk_classes(o, "o_custkey", "o_orderkey", "o_totalprice", 2e6, soft, hard).select("o_orderkey", "class")


@query("SELECT conv_id, turn, e AS expected FROM (SELECT conv_id, turn + CASE WHEN conv_id % 9 = 0 AND turn > 0 THEN 1 ELSE 0 END AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS e FROM conversations) WHERE turn <> e")
def w09_contiguity(spark, sf_dir):
    """Every ninth conversation gets a gap after its first turn."""
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") > 0), 1).otherwise(0)).cast("long").alias("turn"))
    return packages.contiguity(c, ["conv_id"], "turn").select("conv_id", "turn", "expected")


@query("SELECT doc_id, 'missing' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def o02_difference_both_ways(spark, sf_dir):
    return packages.differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT l_suppkey AS supplier FROM lineitem INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def o03_intersection(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("supplier")).intersect(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey"))


@query("SELECT i - 1 AS place, k = n AS equal FROM (SELECT o_orderkey AS k, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders QUALIFY i <= 12) JOIN (SELECT o_orderkey AS n, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders WHERE o_orderkey <> (SELECT o_orderkey FROM orders ORDER BY 1 OFFSET 8 LIMIT 1) QUALIFY i <= 12) USING (i)")
def o05_ordered_prefix(spark, sf_dir):
    """The first twelve orders against a list that lacks the ninth."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    ninth = o.select("o_orderkey").orderBy("o_orderkey").limit(9).agg(F.max("o_orderkey").alias("o_orderkey"))
    return packages.same_prefix(o, o.join(F.broadcast(ninth), "o_orderkey", "left_anti"), ["o_orderkey"], 12)


@query("SELECT count(*) AS n_different FROM ((SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 1000 <> 0))")
def o05_frozen_prefix(spark, sf_dir):
    """Rows by which a changed copy differs from the frozen one, both ways."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    new = o.where("o_orderkey % 1000 <> 0")
    return o.exceptAll(new).unionByName(new.exceptAll(o)).agg(F.count("*").alias("n_different"))


@query("""SELECT c_custkey, 'item_' || substr(sha256('{"key":' || c_custkey || ',"name":"' || c_name || '"}' || chr(10)), 1, 24) AS item_id FROM customer""")
def t16_stable_ids(spark, sf_dir):
    json = F.concat(F.lit('{"key":'), "c_custkey", F.lit(',"name":'), T.json_string(F.col("c_name")), F.lit("}"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.stable_id("item_", json, newline=True).alias("item_id"))
