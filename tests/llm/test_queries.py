"""The registered queries: SQL where there is some, and the pipeline end to end."""

import pytest
from oracle import compare, connect

from speechlake.llm import url_rules
from speechlake.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equal_to_sql(spark, name):
    assert compare(name, queries()[name](spark, SF), connect(SF), oracle_sql()[name]) == ""


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), docs.schema)
        assert docs.columns == columns and 0 < docs.count() <= n, name
        n = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.select("doc_id").distinct().count() == n
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, run.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, out.select("doc_id", "piece", "ids_crc32").collect()))


def test_quality_rules_where_cutoffs_decide(spark):
    """At sf0.1 labels certify cutoffs, and the SQL finds the same ones."""
    sf = "/root/testdata/sf0.1"
    got = queries()["op1_quality_rules"](spark, sf).cache()
    assert got.where("not base_failed and not kept").count() > 100
    assert compare("op1_quality_rules", got, connect(sf), oracle_sql()["op1_quality_rules"]) == ""


def test_url_rules_on_given_labels(spark):
    """The given labels don't depend on urls: fixed rules decide, and a planted signal is found."""
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.1"
    assert queries()["op6_url_rules"](spark, sf).where("rule is null and verdict = 'block'").count() == 0
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    planted = pages.select(F.col("page_id").alias("doc_id"), F.when(F.col("url").contains("/fr/"), 0).otherwise(1).alias("quality"), F.lit(0).alias("toxic"))
    got = url_rules.judge(pages, planted).where("rule is null")
    assert got.where("verdict = 'block'").count() > 50 and got.where("verdict = 'block' and not path like '/fr/%'").count() == 0


def test_pipeline_against_brute_force(spark):
    """Stage by stage on whole texts: who stays, by other means."""
    import corpus_pipeline
    from test_operators import brute_counts, brute_near

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    good = {d for d, t in rows if (c := brute_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    kept = stages["quality_rules"](spark, docs, SF)
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == good  # so few labels certify nothing
    # Near copies: exactly those that the 5-shingles of all pairs name, but for pairs that lie too far apart in bits.
    pairs = [r for r in rows if r[0] in good]
    group = brute_near(pairs)
    least = {min(d for (d, _), g in zip(pairs, group, strict=True) if g == own) for own in set(group)}
    left = {r["doc_id"] for r in stages["simhash_balls"](spark, docs.where(docs.doc_id.isin(list(good))), SF).select("doc_id").collect()}
    assert least <= left and len(left - least) <= 0.05 * (len(pairs) - len(least))


def test_near_copies_recall(spark):
    """At sf0.1, against all pairs of distinct texts with a Jaccard similarity of 0.8 (found by a prefix join): of the
    documents that should go for such a pair, 95 % go, and no others."""
    from collections import Counter, defaultdict
    from math import ceil

    from speechlake.llm import simhash_balls

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    first: dict[str, int] = {}
    for d, t in sorted(map(tuple, docs.collect())):
        first.setdefault(t or "", d)
    ids, sets = [], []
    for t, d in first.items():
        w = t.encode().lower().split()
        if w:
            ids.append(d)
            sets.append({hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))})
    count = Counter(g for s in sets for g in s)
    root = {d: d for d in ids}
    find = lambda x: x if root[x] == x else find(root[x])
    seen = defaultdict(list)
    for i in sorted(range(len(sets)), key=lambda i: len(sets[i])):
        s, met = sets[i], set()
        prefix = sorted(s, key=lambda g: (count[g], g))[: len(s) - ceil(0.8 * len(s)) + 1]
        for g in prefix:
            if count[g] > 1:
                met.update(seen[g])
                seen[g].append(i)
        for j in met:
            both = len(s & sets[j])
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    go = {d for d in ids if find(d) != d}
    gone = set(first.values()) - {r["doc_id"] for r in simhash_balls.near_copies(docs).select("doc_id").collect()}
    print("near copies that should go, go, wrongly:", len(go), len(go & gone), len(gone - go))
    assert len(go) > 20 and len(go & gone) >= 0.95 * len(go) and len(gone - go) <= len(go - gone)
