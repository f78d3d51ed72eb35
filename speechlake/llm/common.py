"""Shared pieces: what a word is, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import discard, numbered, remembered, scratch, table, written

__all__ = ["SPACE", "WORD", "components", "discard", "numbered", "remembered", "scratch", "table", "written"]

#: ASCII white space; every other character belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

def _pairs(df: DataFrame, a: str | Column, b: str | Column) -> DataFrame:
    return df.select((F.col(a) if isinstance(a, str) else a).alias("a"), (F.col(b) if isinstance(b, str) else b).alias("b"))


#: Rows of a few bytes that one task takes.
_TASK_ROWS = 200_000


def few_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df, which comes from about so many rows, in as many tasks as these need: small tables between the rounds of a
    loop don't take a file and a task for each shuffle partition."""
    return df.coalesce(max(1, -(-rows // _TASK_ROWS)))


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): root is the smallest node reachable.

    Alternating large-star and small-star joins; each round ends in a written table, and rounds go on
    until the links stay the same. Nothing but a count and a checksum reaches the driver. Nodes
    without a link are not in the result."""
    now = written(_pairs(links.where("a <> b"), F.greatest("a", "b"), F.least("a", "b")).distinct())
    seen = None
    while True:
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()
        seen = mark
        n = mark[0]
        both = now.union(_pairs(now, "b", "a"))
        low = few_tasks(both.groupBy(F.col("a").alias("_sl_u")).agg(F.min("b").alias("_sl_m")).withColumn("_sl_m", F.least("_sl_u", "_sl_m")), n)
        large = few_tasks(both.where("b > a").join(low, F.col("a") == F.col("_sl_u")), n)
        large = _pairs(large, "b", "_sl_m")
        low = few_tasks(large.groupBy(F.col("a").alias("_sl_u")).agg(F.min("b").alias("_sl_m")), n)
        small = _pairs(large.join(low, F.col("a") == F.col("_sl_u")).where("b > _sl_m"), "b", "_sl_m").union(_pairs(low, "_sl_u", "_sl_m"))
        last, now = now, written(few_tasks(few_tasks(small, n).distinct(), n))
        discard(last)
