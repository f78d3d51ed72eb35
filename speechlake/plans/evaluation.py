"""Queries over evaluation, batching and control operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batching, control
from ..operators import evaluation as E
from ..operators import quantiles as Q
from ..registry import query
from ..sources import sinks
from ..tables import scratch, table, written


def _matrix(spark, sf_dir):
    return E.matrix(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("system_id")), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id")))


@query("SELECT n_nationkey AS system_id, item_id AS text_id, n_nationkey || '__' || item_id AS job_id, s_suppkey AS reference_id, s_name AS reference_name FROM nation, benchmark JOIN supplier ON s_suppkey = item_id % 7 + 1")
def j07_job_matrix(spark, sf_dir):
    """Suppliers as reference clips: seven of them serve all texts."""
    texts = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id"), (F.col("item_id") % 7 + 1).alias("reference_id"))
    refs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reference_id"), F.col("s_name").alias("reference_name"))
    return E.with_references(_matrix(spark, sf_dir), texts, refs)


_LAST = "(SELECT user_id, event_type, max_by(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL)"


@query(f"SELECT user_id, event_type, event_id, round(value, 6) AS value FROM {_LAST}")
def w03_latest_record(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return E.latest(log.withColumn("o", F.col("event_id")), ["user_id", "event_type"], "o").select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


@query("SELECT user_id FROM events GROUP BY user_id HAVING max_by(event_type, event_id) IN ('error', 'view') AND user_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def j08_resume(spark, sf_dir):
    """Users as jobs: those whose latest event is an error or a view are still to do, if their file (a customer) is there."""
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type").withColumn("o", F.col("event_id"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("user_id"))
    return E.unfinished(log.select("user_id").distinct(), log, "user_id", "o", ~F.col("event_type").isin("error", "view"), files)


@query("""WITH a AS (SELECT user_id, max_by(value, event_id) FILTER (WHERE value > 1) AS first_value, max_by(event_id, event_id) AS last_id FROM events WHERE event_type IN ('view', 'click') GROUP BY 1),
  b AS (SELECT user_id, max_by(value, event_id) AS cer FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY 1),
  f AS (SELECT user_id, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS failed FROM events GROUP BY 1)
  SELECT user_id, failed, round(first_value, 6) AS first_value, last_id, round(cer, 6) AS cer FROM f LEFT JOIN a USING (user_id) LEFT JOIN b USING (user_id)""")
def j09_metric_merge(spark, sf_dir):
    """Views, clicks and errors as one log with a field that is often missing and a foreign cer; purchases and signups
    as the log that has the cer."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value").withColumn("ok", ~F.col("event_type").isin("error", "signup"))
    own = e.where(F.col("event_type").isin("view", "click", "error")).select("user_id", "event_id", "ok", F.when(F.col("value") > 1, F.col("value")).alias("first_value"), F.col("event_id").alias("last_id"), F.lit(-1.0).alias("cer"))
    other = e.where(F.col("event_type").isin("purchase", "signup")).select("user_id", "event_id", "ok", F.col("value").alias("cer"))
    m = E.merged_metrics(own, other, ["user_id"], ["first_value", "last_id"], "cer", "event_id")
    return m.select("user_id", "failed", F.round("first_value", 6).alias("first_value"), "last_id", F.round("cer", 6).alias("cer"))


_NORM = "regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g')"


@query(f"""WITH a AS (SELECT item_id, {_NORM} AS t FROM benchmark), b AS (SELECT doc_id, {_NORM} AS t FROM documents),
  ga AS (SELECT DISTINCT item_id, substr(t, i::BIGINT, 3) AS g FROM a, LATERAL (SELECT unnest(range(1, length(t) - 1)) AS i)),
  gb AS (SELECT DISTINCT doc_id, substr(t, i::BIGINT, 3) AS g FROM b, LATERAL (SELECT unnest(range(1, length(t) - 1)) AS i)),
  na AS (SELECT item_id, count(*) AS n FROM ga GROUP BY 1), nb AS (SELECT doc_id, count(*) AS n FROM gb GROUP BY 1),
  k AS (SELECT item_id, doc_id, count(*) AS k FROM ga JOIN gb USING (g) GROUP BY 1, 2),
  j AS (SELECT item_id, max(k / (na.n + nb.n - k)) AS j FROM k JOIN na USING (item_id) JOIN nb USING (doc_id) GROUP BY 1)
  SELECT a.item_id, round(coalesce(j, 0), 6) AS max_jaccard, a.t IN (SELECT t FROM b) AS exact, a.t IN (SELECT t FROM b) OR round(coalesce(j, 0), 6) >= 0.3 AS leaked FROM a LEFT JOIN j ON a.item_id = j.item_id""")
def j10_leakage(spark, sf_dir):
    return E.leakage(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents").select("doc_id", "text"), 3, 0.3)


_RANK = "max(CASE WHEN r = round_even((n - 1) * {f}, 0)::BIGINT + 1 THEN v END)"


@query(f"""SELECT o_orderpriority, round({_RANK.format(f=0.1)}, 6) AS p10, round({_RANK.format(f=0.5)}, 6) AS p50, round({_RANK.format(f=0.9)}, 6) AS p90 FROM (
  SELECT o_orderpriority, o_totalprice AS v, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) GROUP BY 1""")
def a07_nearest_rank(spark, sf_dir):
    q = Q.nearest_rank(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("o_orderpriority", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query(f"""SELECT l_returnflag, l_linestatus, round({_RANK.format(f=0.01)}, 6) AS price_p01, round({_RANK.format(f=0.999)}, 6) AS price_p999, round(quantile_cont(v, 0.25), 6) AS price_q1, round(quantile_cont(v, 0.75), 6) AS price_q3,
  round(quantile_cont(q, 0.5), 6) AS quantity_median, round(quantile_cont(v, 0.5) FILTER (WHERE q > 25), 6) AS large_median FROM (
  SELECT l_returnflag, l_linestatus, l_extendedprice AS v, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS r, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS n FROM lineitem) GROUP BY ALL""")
def u04_grouped_quantiles(spark, sf_dir):
    """Two metrics and a condition, six quantiles, in the same passes."""
    picks = {
        "price_p01": Q.Quantile("price", 0.01), "price_p999": Q.Quantile("price", 0.999), "price_q1": Q.Quantile("price", 0.25, linear=True), "price_q3": Q.Quantile("price", 0.75, linear=True),
        "quantity_median": Q.Quantile("quantity", 0.5, linear=True), "large_median": Q.Quantile("price", 0.5, linear=True, where=F.col("quantity") > 25),
    }
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_extendedprice").cast("double").alias("price"), F.col("l_quantity").cast("double").alias("quantity"))
    q = Q.quantiles(rows, ["l_returnflag", "l_linestatus"], picks)
    return q.select("l_returnflag", "l_linestatus", *[F.round(n, 6).alias(n) for n in picks])


_SUM = f"""(SELECT l_suppkey, count(v) AS v_n, round(avg(v), 6) AS v_mean, round(median(v), 6) AS v_median, max(v) AS v_max, {_RANK.format(f=0.1)} AS v_p10, {_RANK.format(f=0.9)} AS v_p90,
  count(*) FILTER (WHERE q > 49) AS hard_failures, count(*) AS n_rows, max(v) FILTER (WHERE core) AS core_v_max, round(median(v) FILTER (WHERE core), 6) AS core_v_median, max(CASE WHEN core AND rc = round_even((nc - 1) * 0.9, 0)::BIGINT + 1 THEN v END) AS core_v_p90 FROM (
  SELECT l_suppkey, l_discount / 3 AS v, l_quantity AS q, l_linenumber <= 2 AS core, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_discount) AS r, count(*) OVER (PARTITION BY l_suppkey) AS n,
    row_number() OVER (PARTITION BY l_suppkey, l_linenumber <= 2 ORDER BY l_discount) AS rc, count(*) OVER (PARTITION BY l_suppkey, l_linenumber <= 2) AS nc FROM lineitem) GROUP BY 1)"""


def _summary(spark, sf_dir):
    """Suppliers as systems, their line items as score rows (a third of the discount: means of hundredths would often
    lie between two roundings); the first two lines of an order are the core split."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_discount") / 3).alias("v"), "l_quantity", "l_linenumber")
    return E.metric_summary(rows, ["l_suppkey"], "v", F.col("l_linenumber") <= 2, {"hard_failures": F.count_if(F.col("l_quantity") > 49), "n_rows": F.count("*")})


@query(f"SELECT * FROM {_SUM}")
def a08_system_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


#: name -> (metric, comparison, limit of the difference from the baseline)
_CHECKS = {"mean_ok": ("v_mean", "<=", 0.001), "p90_ok": ("v_p90", "<=", 0.005), "p10_ok": ("v_p10", ">=", -0.01), "median_ok": ("v_median", "<=", 0.002), "max_ok": ("v_max", "<=", 0.0), "core_ok": ("core_v_p90", "<=", 0.01)}
_SQL_CHECKS = ", ".join(f"{m} - b_{m} {op} {x} AS {name}" for name, (m, op, x) in _CHECKS.items())


@query(f"""WITH s AS {_SUM}, b AS (SELECT {', '.join(f'{m} AS b_{m}' for m, _, _ in _CHECKS.values())} FROM s WHERE l_suppkey = (SELECT min(l_suppkey) FROM s)),
  j AS (SELECT l_suppkey, hard_failures, n_rows, l_suppkey = (SELECT min(l_suppkey) FROM s) AS baseline, {_SQL_CHECKS} FROM s, b),
  v AS (SELECT *, CASE WHEN {' AND '.join(f'{c} IS NOT NULL' for c in _CHECKS)} THEN {' AND '.join(_CHECKS)} END AS verdict, n_rows = 600 AS complete FROM j)
  SELECT l_suppkey, {', '.join(_CHECKS)}, verdict, complete, complete AND hard_failures = 0 AND (baseline OR coalesce(verdict, false)) AS passed FROM v""")
def a12_objective_verdict(spark, sf_dir):
    s = written(_summary(spark, sf_dir))
    first = s.agg(F.min("l_suppkey").alias("_low"))
    baseline = F.col("l_suppkey") == F.col("_low")
    judged = E.verdicts(s.join(F.broadcast(first)), baseline, _CHECKS)
    return E.passed(judged, baseline, 600, "n_rows", "hard_failures").select("l_suppkey", *_CHECKS, "verdict", "complete", "passed")


_PARETO = """SELECT a.p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_brand = a.p_brand AND b.p_partkey <> a.p_partkey AND b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))"""


@query("""SELECT a.s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey <> a.s_suppkey AND b.s_acctbal >= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR b.s_nationkey < a.s_nationkey))""")
def j11_pareto(spark, sf_dir):
    return E.pareto(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey"), "s_suppkey", ["s_nationkey"], ["s_acctbal"]).select("s_suppkey")


@query("""SELECT a.s_suppkey FROM supplier a WHERE NOT EXISTS (SELECT 1 FROM supplier b WHERE b.s_suppkey <> a.s_suppkey AND b.s_acctbal >= a.s_acctbal AND b.s_nationkey <= a.s_nationkey AND (b.s_acctbal > a.s_acctbal OR b.s_nationkey < a.s_nationkey)) ORDER BY 1 LIMIT 3""")
def k05_shortlist(spark, sf_dir):
    return j11_pareto(spark, sf_dir).orderBy("s_suppkey").limit(3)


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN NOT l_quantity <= 40 THEN 'clipping;' ELSE '' END) || (CASE WHEN NOT (l_extendedprice BETWEEN 2000 AND 60000) THEN 'duration;' ELSE '' END) || (CASE WHEN NOT coalesce(nullif(l_discount, 0) <= 0.08, false) THEN 'silence;' ELSE '' END) AS failed FROM lineitem""")
def f08_hard_gates(spark, sf_dir):
    """Line items as score rows; a discount of 0 counts as a missing metric, which fails."""
    gates = {"clipping;": F.col("l_quantity") <= 40, "duration;": F.col("l_extendedprice").between(2000, 60000), "silence;": F.nullif(F.col("l_discount"), F.lit(0.0)) <= 0.08}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array_join(E.gate_failures(gates), "").alias("failed"))


@query("""SELECT event_type, round(sum(value) / sum(value + 1), 6) AS rtf, round(avg(value) * 1000, 3) AS mean_ms, round(var_pop(value) * 1000, 3) AS variance, round(quantile_cont(value, 0.5) * 1000, 3) AS p50_ms,
  round(quantile_cont(value, 0.9) * 1000, 3) AS p90_ms, round(quantile_cont(value, 0.95) * 1000, 3) AS p95_ms, round(quantile_cont(value, 0.99) * 1000, 3) AS p99_ms FROM events GROUP BY 1""")
def a10_latency(spark, sf_dir):
    return E.latency(table(spark, sf_dir, "events").withColumn("audio", F.col("value") + 1), ["event_type"], "value", "audio")


@query("""WITH o AS (SELECT l_orderkey AS k, l_discount AS a, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL), e AS (SELECT k, min_by(v, a) AS b, max_by(v, a) AS t FROM o GROUP BY 1),
  p AS (SELECT a, (v - b) / (t - b) AS p FROM o JOIN e USING (k) WHERE abs(t - b) >= 1e-6)
  SELECT a AS alpha, count(*) AS n, round(avg(p), 4) AS mean, round(coalesce(stddev_samp(p), 0), 4) AS sd, round(avg(p) - a, 4) AS error FROM p GROUP BY 1""")
def a13_response_curve(spark, sf_dir):
    """Discounts as alpha, one seed for each order."""
    v = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_discount").alias("alpha")).agg(F.avg("l_extendedprice").alias("value"))
    return E.response(v, "l_orderkey", "alpha", "value").select("alpha", "n", *[F.round(c, 4).alias(c) for c in ("mean", "sd", "error")])


@query("""WITH o AS (SELECT l_orderkey, l_quantity AS v, lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS p FROM lineitem)
  SELECT l_orderkey, count(*) AS n, CASE WHEN count(*) < 3 THEN 'insufficient' WHEN bool_and(p <= v + 1e-6) THEN 'increasing' WHEN bool_and(p >= v - 1e-6) THEN 'decreasing' ELSE 'non-monotone' END AS response FROM o GROUP BY 1""")
def w11_monotonicity(spark, sf_dir):
    return E.monotonicity(table(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_quantity"], "l_quantity")


@query("SELECT count(value) AS n, round(avg(value), 4) AS mean FROM events")
def s15_results_headline(spark, sf_dir):
    return sinks.write_results(table(spark, sf_dir, "events").select("event_id", "value"), scratch(spark), "value", 4)


@query("SELECT event_type, round(avg(value), 5) AS mean FROM events GROUP BY 1")
def a09_metric_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 5).alias("mean"))


@query("SELECT n_nationkey || '__' || item_id AS job_id, 'Y' || upper(substr(sha256('secret' || chr(0) || n_nationkey || '__' || item_id), 1, 10)) AS code FROM nation, benchmark")
def k06_blind_codes(spark, sf_dir):
    jobs = _matrix(spark, sf_dir)
    return jobs.select("job_id", E.blind_code("secret", F.col("job_id")).alias("code"))


@query()
def k06_blind_order(spark, sf_dir):
    """One bundle for each region; the places are checked for adjacency in tests."""
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("system_id"), F.col("n_regionkey").cast("long").alias("bundle_id"))
    jobs = E.matrix(nations, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("text_id")))
    return E.listening(jobs, "secret")


# batching

_GREEDY = """WITH RECURSIVE r AS (SELECT doc_id, n_chars AS l, row_number() OVER (ORDER BY n_chars, doc_id) AS i FROM documents WHERE n_chars BETWEEN 1 AND {budget}),
  g AS (SELECT i, doc_id, l, 0::BIGINT AS batch_id, 1::BIGINT AS n, l AS used FROM r WHERE i = 1
    UNION ALL SELECT r.i, r.doc_id, r.l, CASE WHEN {close} THEN g.batch_id + 1 ELSE g.batch_id END, CASE WHEN {close} THEN 1 ELSE g.n + 1 END, CASE WHEN {close} THEN r.l ELSE g.used + r.l END FROM g JOIN r ON r.i = g.i + 1)
  SELECT doc_id, batch_id FROM g"""


@query(_GREEDY.format(budget=38400, close="g.used + r.l > 38400 OR g.n >= 64"))
def w05_sum_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("frames"))
    return batching.sum_batches(rows, "frames", "doc_id", 38400, 64).select("doc_id", "batch_id")


@query(_GREEDY.format(budget=38400, close="r.l * (g.n + 1) > 38400 OR g.n >= 64"))
def w06_padded_batches(spark, sf_dir):
    return _padded(spark, sf_dir).select("doc_id", "batch_id")


def _padded(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("long").alias("frames"))
    return batching.padded_batches(rows, "frames", "doc_id", 38400, 64)


@query(f"""WITH b AS ({_GREEDY.format(budget=38400, close="r.l * (g.n + 1) > 38400 OR g.n >= 64").replace('SELECT doc_id, batch_id FROM g', 'SELECT l, batch_id FROM g')})
  SELECT batch_id, count(*) AS n, max(l) AS longest, round(sum(l) / (max(l) * count(*)), 6) AS efficiency FROM b GROUP BY 1""")
def t14_padding(spark, sf_dir):
    return batching.padding(_padded(spark, sf_dir), "frames")


@query("""SELECT conv_id AS batch_id, turn, len(string_split(text, ' '))::BIGINT AS length, max(len(string_split(text, ' '))) OVER (PARTITION BY conv_id)::BIGINT AS padded,
  list_sum(list_transform(string_split(text, ' '), lambda w: length(w)))::BIGINT - (max(len(string_split(text, ' '))) OVER (PARTITION BY conv_id) - len(string_split(text, ' ')))::BIGINT AS total FROM conversations WHERE text <> ''""")
def t14_collated(spark, sf_dir):
    """Conversations as batches: word lengths as ids, padded with -1 to the longest turn."""
    ids = F.transform(F.split("text", " "), lambda w: F.length(w).cast("long"))
    rows = table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("batch_id"), "turn", ids.alias("ids"))
    c = batching.collated(rows, "ids")
    return c.select("batch_id", "turn", F.col("length").cast("long").alias("length"), F.size("ids").cast("long").alias("padded"), F.aggregate("ids", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"))


@query("SELECT doc_id, floor((n_chars - 45) / 556.0 * 200)::BIGINT AS bucket FROM documents WHERE n_chars BETWEEN 45 AND 600")
def w07_length_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("n_chars between 45 and 600")
    return rows.select("doc_id", batching.length_bucket(F.col("n_chars"), 45, 600).alias("bucket"))


@query("""WITH RECURSIVE r AS (SELECT doc_id, n_chars AS l, floor((n_chars - 45) / 556.0 * 200)::BIGINT AS bucket, row_number() OVER (PARTITION BY floor((n_chars - 45) / 556.0 * 200) ORDER BY doc_id) AS i FROM documents WHERE n_chars BETWEEN 45 AND 600),
  g AS (SELECT bucket, i, doc_id, l, 0::BIGINT AS k, l AS used FROM r WHERE i = 1
    UNION ALL SELECT r.bucket, r.i, r.doc_id, r.l, CASE WHEN g.used >= 3000 THEN g.k + 1 ELSE g.k END, CASE WHEN g.used >= 3000 THEN r.l ELSE g.used + r.l END FROM g JOIN r ON r.bucket = g.bucket AND r.i = g.i + 1)
  SELECT doc_id, bucket, l AS n_chars, k AS batch_in_bucket FROM g""")
def w07_bucket_batches(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("n_chars between 45 and 600").select("doc_id", "n_chars", batching.length_bucket(F.col("n_chars"), 45, 600).alias("bucket"))
    return batching.bucket_batches(rows, "bucket", "n_chars", "doc_id", 3000)


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents")
def k02_longest_first(spark, sf_dir):
    from ..tables import numbered

    rows = table(spark, sf_dir, "documents").select("doc_id", (-F.col("n_chars")).alias("_n"))
    return numbered(rows, ["_n", "doc_id"], "place").select("doc_id", (F.col("place") + 1).alias("place"))


@query("SELECT doc_id, sha256('7|3|' || doc_id) AS sort_key FROM documents")
def k04_seeded_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", batching.seeded_order(F.col("doc_id"), 7, 3).alias("sort_key"))
    return rows.orderBy("sort_key")


# control

@query("SELECT user_id % 10 AS run, event_type AS state, count(*) AS n FROM events GROUP BY ALL")
def a11_status_rollup(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("run"), F.col("event_type").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_orderpriority, row_number() OVER w AS rank, count(*) OVER (PARTITION BY o_orderpriority) >= 8 AS enough FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) QUALIFY rank <= 8")
def w02_top_per_stratum(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return control.top_per_stratum(o, "o_orderpriority", ["o_totalprice", "o_orderkey"], 8).select("o_orderkey", "o_orderpriority", "rank", "enough")


LEGAL = [("view", "click"), ("click", "purchase"), ("view", "view"), ("click", "view"), ("purchase", "view"), ("signup", "view"), ("error", "view"), ("view", "error"), ("view", "signup")]
_PAIRS = ", ".join(f"('{a}', '{b}')" for a, b in LEGAL)


@query(f"""SELECT user_id, event_id, state, next_state FROM (SELECT user_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS state, event_type AS next_state FROM events)
  WHERE state IS NOT NULL AND (state, next_state) NOT IN ({_PAIRS})""")
def w08_chain_audit(spark, sf_dir):
    legal = spark.createDataFrame(LEGAL, "state string, next_state string")
    return control.chain_audit(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", legal).select("user_id", "event_id", "state", "next_state")


@query("SELECT user_id FROM events GROUP BY 1 HAVING min(event_id) FILTER (WHERE event_type = 'signup') < max(event_id) FILTER (WHERE event_type = 'purchase')")
def w08_reached_then(spark, sf_dir):
    return control.reached_then(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("event_type") == "signup", F.col("event_type") == "purchase")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS since FROM events")
def w10_forward_fill(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    return control.filled(e, ["user_id"], "event_id", F.when(F.col("event_type") == "signup", F.col("event_id")), "since").select("event_id", "since")


_SESS = """(SELECT event_id, user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS session FROM (
  SELECT event_id, user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS n FROM events))"""


@query(f"SELECT event_id, session FROM {_SESS}")
def w13_gap_sessions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return control.sessions(e, "user_id", at, ["ts", "event_id"], 3600).select("event_id", "session")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def k03_next_item(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus").withColumn("k", F.col("o_orderkey"))
    return control.next_item(o, ["o_custkey"], "k", F.col("o_orderstatus") == "O").select("o_custkey", "o_orderkey")


_TRACE = "(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step, value FROM events)"


@query(f"""WITH t AS (SELECT * FROM {_TRACE} WHERE NOT (user_id % 4 = 0 AND step = 5)), r AS (SELECT step, value FROM t WHERE user_id = (SELECT min(user_id) FROM events)), o AS (SELECT DISTINCT user_id FROM events WHERE user_id <> (SELECT min(user_id) FROM events))
  SELECT o.user_id, count(r.step) AS n, round(max(abs(t.value - r.value)), 6) AS largest, count(*) FILTER (WHERE abs(t.value - r.value) > 1.5) AS exceeding,
    (SELECT string_agg(a, ',' ORDER BY a) FROM (SELECT unnest([1, 5, 10]) AS a) WHERE NOT EXISTS (SELECT 1 FROM t x WHERE x.user_id = o.user_id AND x.step = a)) AS missing
  FROM o LEFT JOIN t ON t.user_id = o.user_id LEFT JOIN r USING (step) GROUP BY o.user_id""")
def j14_trace_comparison(spark, sf_dir):
    """Every fourth user lacks step 5; steps 1, 5 and 10 are the anchors that each trace needs."""
    from pyspark.sql import Window as W

    t = table(spark, sf_dir, "events").select("user_id", F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("step"), "value").where("not (user_id % 4 = 0 and step = 5)")
    first = table(spark, sf_dir, "events").agg(F.min("user_id")).first()[0]
    return control.trace_differences(t, "user_id", "step", "value", F.lit(first), 1.5, anchors=[1, 5, 10])


@query("SELECT conv_id, turn, CASE WHEN role IN ('user', 'assistant') THEN role ELSE 'main' END AS used, CASE WHEN role = 'user' THEN 1.1 WHEN role = 'assistant' THEN 0.9 ELSE 1.0 END::DOUBLE AS speed FROM conversations")
def j16_voice_lookup(spark, sf_dir):
    voices = spark.createDataFrame([("user", 1.1), ("assistant", 0.9), ("main", 1.0)], "role string, speed double")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return control.with_default(rows, voices, "role", ["speed"], F.lit("main")).select("conv_id", "turn", "used", "speed")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'valid' WHEN 'O' THEN 'invalid_for_selection' ELSE 'forensic_only' END AS verdict, o_orderstatus NOT IN ('F', 'O') AS resume_prohibited, o_orderstatus <> 'F' AS selection_prohibited, o_orderstatus <> 'F' AS deployment_prohibited, o_orderstatus NOT IN ('F', 'O') AS forensic FROM orders""")
def t25_adjudication(spark, sf_dir):
    v = F.when(F.col("o_orderstatus") == "F", "valid").when(F.col("o_orderstatus") == "O", "invalid_for_selection").otherwise("forensic_only")
    return control.dispositions(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), v).select("o_orderkey", "verdict", "resume_prohibited", "selection_prohibited", "deployment_prohibited", "forensic")
