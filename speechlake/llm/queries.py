"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bestfit_packing, decontamination, line_dedup, prefix_trie, quality_rules, simhash_balls, spelling, substring_dedup, suffix_dedup, token_counts, token_planes, url_rules, vector_sharding
from .common import scratch, table, written


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    judged = quality_rules.judge(docs, table(spark, sf_dir, "labels"), keep_text=False)
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op2_bit_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_planes.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"), "byte", end_id=0)
    return token_planes.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_sharding.shard(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url"), table(spark, sf_dir, "labels"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), window=13)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = bestfit_packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("word_bpe_49k.json"), "word", end_id=0, capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), full=True)
    return kept.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines_kept"), F.col("_sl_removed").alias("n_removed"), F.crc32("text").alias("kept_crc32"), F.md5("text").alias("kept_md5"))


def op10_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_balls.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = written(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    c = F.col("conv_id")
    rows, convs = prefix_trie.rebuilt(turns, F.crc32(c.cast("string").cast("binary")) % 6, c - c % 100, heads=5)
    return prefix_trie.trie(rows, convs)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=100)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_WORD = r"'[^\x20\x09-\x0D]+'"

_OP1 = f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {_WORD})) AS ls FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g FROM w, unnest(range(1, len(w) - 3)) u(i)),
  r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
  c AS (SELECT doc_id, count(DISTINCT p) AS n FROM r, unnest(range(i, i + 5)) u(p) GROUP BY 1),
  f AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper
    FROM w LEFT JOIN c ON w.doc_id = c.doc_id),
  s AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    CASE WHEN word_chars > 0 THEN floor(10000 * n_symbols / word_chars) ELSE 0 END AS symbol, CASE WHEN n_words > 0 THEN floor(10000 * n_repeat_words / n_words) ELSE 0 END AS repeat,
    CASE WHEN n_lines > 0 THEN floor(10000 * n_dup_lines / n_lines) ELSE 0 END AS dup_line, CASE WHEN word_chars > 0 THEN floor(10000 * n_upper / word_chars) ELSE 0 END AS shout FROM f),
  good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(quality) = 1),
  x AS (UNPIVOT (SELECT lang, symbol, repeat, dup_line, shout FROM s SEMI JOIN good USING (doc_id)) ON symbol, repeat, dup_line, shout INTO NAME rule VALUE v),
  k AS (SELECT lang, rule, cut, count(*) AS n, count(*) FILTER (WHERE v >= cut) AS k FROM x, unnest([{", ".join(map(str, quality_rules.GRID))}]) u(cut) GROUP BY ALL),
  ok AS (SELECT lang, rule, cut, CASE WHEN k >= n * 0.0125 THEN 1.0 ELSE
      list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0125) + (n - j) * ln(0.9875)))) END <= 0.05 / (4 * (SELECT count(DISTINCT lang) FROM x)) AS ok FROM k),
  p AS (SELECT lang, rule, cut, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY cut DESC ROWS UNBOUNDED PRECEDING) AS ok FROM ok),
  cuts AS (SELECT lang, min(cut) FILTER (WHERE rule = 'symbol') AS a, min(cut) FILTER (WHERE rule = 'repeat') AS b, min(cut) FILTER (WHERE rule = 'dup_line') AS c, min(cut) FILTER (WHERE rule = 'shout') AS d FROM p WHERE ok GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (coalesce(symbol >= a, false) OR coalesce(repeat >= b, false) OR coalesce(dup_line >= c, false) OR coalesce(shout >= d, false)) AS kept FROM s LEFT JOIN cuts USING (lang)"""

_OP7 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
  g AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS g FROM w, unnest(range(1, len(w) - 11)) u(i)),
  r AS (SELECT doc_id, i FROM g QUALIFY min(doc_id) OVER (PARTITION BY g) < doc_id),
  c AS (SELECT DISTINCT doc_id, p FROM r, unnest(range(i, i + 13)) u(p)),
  v AS (SELECT w.doc_id, string_agg(w[u.p], ' ' ORDER BY u.p) FILTER (WHERE c.p IS NULL) AS kept, count(c.p) AS n_removed FROM w, unnest(range(1, len(w) + 1)) u(p) LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = u.p GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN v ON w.doc_id = v.doc_id"""


_CRC = """t AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """SQL for the unsigned crc32 of a string's UTF-8 bytes, by the table t of ``_CRC``."""
    octets = f"list_transform(range(0, length(hex(encode({text}))) // 2), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


_OP11 = f"""
WITH {_CRC},
  s AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role, text) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
  h AS (SELECT conv_id, ts, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM s, t),
  b AS (SELECT h.conv_id, list_concat(coalesce(s.ts, [])[:h], h.ts[h + 1:]) AS ts FROM h LEFT JOIN s ON s.conv_id = h.conv_id - h.conv_id % 100),
  p AS (SELECT conv_id, d, len(ts) AS n, CASE WHEN d > 0 THEN length(ts[d].t) ELSE 0 END AS size, [md5(x.r || chr(0) || x.t) for x in ts[:d]] AS k FROM b, unnest(range(0, len(ts) + 1)) u(d)),
  k AS (SELECT conv_id, d, n, size, array_to_string(k, ',') AS k, array_to_string(k[:d - 1], ',') AS up FROM p),
  g AS (SELECT k, d, min(conv_id) AS least, count(*) AS n_convs, any_value(up) AS up, any_value(size) AS size, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM k GROUP BY 1, 2),
  c AS (SELECT up, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2),
  x AS (SELECT g.*, coalesce(c.n_children, 0) AS n_children FROM g LEFT JOIN c ON c.up = g.k AND c.d = g.d),
  f AS (SELECT a.k, a.d, sum((x.n_convs - 1) * x.size)::BIGINT AS saved_tokens, count(*) FILTER (WHERE x.n_children = 0) AS n_leaves FROM x JOIN k a ON a.conv_id = x.least AND a.d <= x.d GROUP BY 1, 2)
SELECT x.least AS conv_id, x.d AS depth, y.least AS parent_conv_id, x.n_convs, x.n_children, n_leaves, saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN f ON f.k = x.k AND f.d = x.d LEFT JOIN x y ON y.k = x.up AND y.d = x.d - 1"""

_OP13 = f"""
WITH RECURSIVE {_CRC},
  r AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')) AS r FROM documents) GROUP BY 1, 2),
  h AS (SELECT r, n, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || r")} AS h FROM r, t),
  v AS (SELECT CASE WHEN h % 31 = 0 THEN left(r, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS w, n FROM h),
  w AS (SELECT w, sum(n)::BIGINT AS n FROM v WHERE length(w) >= 7 GROUP BY 1 HAVING sum(n) >= 2),
  e AS (SELECT w, i, left(w, i - 1) || substr(w, i + 1) AS e FROM w, unnest(range(1, length(w) + 1)) u(i)),
  p AS (SELECT e.w AS a, w.w AS b FROM e JOIN w ON e.e = w.w UNION SELECT w.w, e.w FROM e JOIN w ON e.e = w.w UNION SELECT x.w, y.w FROM e x JOIN e y ON x.e = y.e AND x.i = y.i AND x.w <> y.w),
  q AS (SELECT a, count(*) AS n_near, max(n) AS form_n, arg_min(b, (-n, b)) AS form FROM p JOIN w ON w.w = b GROUP BY 1),
  f AS (SELECT w.w AS word, CASE WHEN form_n >= 10 * n THEN form END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM w LEFT JOIN q ON q.a = w.w),
  c AS (SELECT word, word AS root, form AS nxt FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON f.word = c.nxt)
SELECT f.*, c.root FROM f JOIN c ON c.word = f.word WHERE c.nxt IS NULL"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _OP1, "op7_substring_dedup": _OP7, "op11_prefix_trie": _OP11, "op13_spelling": _OP13}
