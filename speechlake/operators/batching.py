"""Batch planning over lengths.

Greedy batches over length-sorted rows look sequential, but depend on the histogram of lengths alone:
within a run of equal lengths every full batch has the same size. The plan is made from the histogram
(at most one entry for each length up to the budget); rows find their batch by length and rank.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import numbered


@dataclass(frozen=True)
class Run:
    """Rows of one length with ranks lo..hi-1 are in batches first, first + 1, ... of ``size`` rows each."""

    length: int
    lo: int
    hi: int
    first: int
    size: int


def sum_runs(histogram: list[tuple[int, int]], budget: int, most: int = 0, drop_residual: bool = False, oversized: bool = False) -> list[Run]:
    """Batches close when the sum of lengths would pass the budget or they hold ``most`` rows.

    oversized: longer rows follow (they come last and are dropped; the first one closes the open batch,
    so no residual is left then)."""
    return _runs(histogram, most, drop_residual and not oversized, lambda length, used, n: (budget - used) // length, lambda length: budget // length)


def padded_runs(histogram: list[tuple[int, int]], budget: int, most: int = 0) -> list[Run]:
    """Batches close when length * (rows + 1) would pass the budget."""
    return _runs(histogram, most, False, lambda length, used, n: max(0, budget // length - n), lambda length: budget // length)


def _runs(histogram, most, drop_residual, room, full) -> list[Run]:
    out, batch, used, n = [], 0, 0, 0
    for length, count in sorted(histogram):
        at = 0
        while at < count:
            fit = room(length, used, n)
            if most:
                fit = min(fit, most - n)
            if fit > 0 and n > 0 or (n == 0 and fit >= count - at):
                take = min(fit, count - at)
                out.append(Run(length, at, at + take, batch, take))
                at, used, n = at + take, used + take * length, n + take
            elif n > 0:
                batch, used, n = batch + 1, 0, 0
            else:
                size = min(full(length), most) if most else full(length)
                whole = (count - at) // size
                out.append(Run(length, at, at + whole * size, batch, size))
                at, batch = at + whole * size, batch + whole
    if drop_residual and out:
        # The last batch was never closed, full or not.
        last = batch if n else batch - 1
        out = [r if r.first + (r.hi - r.lo) // r.size <= last else Run(r.length, r.lo, r.lo + (last - r.first) * r.size, r.first, r.size) for r in out if r.first < last]
    return out


def _assigned(rows: DataFrame, length: str, order: str, runs: list[Run]) -> DataFrame:
    spark = rows.sparkSession
    table = spark.createDataFrame([(r.length, r.lo, r.hi, r.first, r.size) for r in runs], "_l long, _lo long, _hi long, _first long, _size long")
    # A common length is ranked by many tasks.
    ranked = numbered(rows, [order], "_rank", group=length)
    # At most three runs for each length within the budget.
    j = ranked.join(F.broadcast(table), (F.col(length) == F.col("_l")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    return j.withColumn("batch_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_lo")) / F.col("_size"))).drop("_l", "_lo", "_hi", "_first", "_size", "_rank")


def histogram(rows: DataFrame, length: str, budget: int) -> list[tuple[int, int]]:
    """(length, rows) for each length up to the budget: bounded by the budget."""
    return [(int(r[0]), int(r[1])) for r in rows.where(F.col(length).between(1, budget)).groupBy(length).count().collect()]


def sum_batches(rows: DataFrame, length: str, order: str, budget: int, most: int = 0, drop_residual: bool = False) -> DataFrame:
    """rows with batch_id; longer rows than the budget are dropped."""
    long_ones = bool(rows.where(F.col(length) > budget).limit(1).count()) if drop_residual else False
    return _assigned(rows, length, order, sum_runs(histogram(rows, length, budget), budget, most, drop_residual, long_ones))


def padded_batches(rows: DataFrame, length: str, order: str, budget: int, most: int = 0) -> DataFrame:
    return _assigned(rows, length, order, padded_runs(histogram(rows, length, budget), budget, most))


def length_bucket(frames: Column, lo: int, hi: int, buckets: int = 200) -> Column:
    return F.floor((frames - lo) / (hi - lo + 1) * buckets).cast("long")


def bucket_batches(rows: DataFrame, bucket: str, length: str, order: str, size: int) -> DataFrame:
    """rows with batch_in_bucket: within each bucket, in order, a batch is flushed when its sum reaches size.

    Buckets go through sorted partitions batch by batch; a task holds one running sum, however large a bucket is."""

    def flush(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, used, k = None, 0, 0
        for pdf in batches:
            out = []
            for b, x in zip(pdf[bucket].tolist(), pdf[length].tolist(), strict=True):
                if b != now:
                    now, used, k = b, 0, 0
                out.append(k)
                used += x
                if used >= size:
                    k, used = k + 1, 0
            yield pdf.assign(batch_in_bucket=pd.Series(out, index=pdf.index, dtype="int64"))

    schema = StructType([*rows.schema.fields, StructField("batch_in_bucket", LongType())])
    return rows.repartition(bucket).sortWithinPartitions(bucket, order).mapInPandas(flush, schema)


def seeded_order(key: Column, seed: int, epoch: int) -> Column:
    """Sorting by this gives a permutation that depends on (seed, epoch) only."""
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), key.cast("string")), 256)


def padding(batches: DataFrame, length: str) -> DataFrame:
    """batch_id, rows, longest, efficiency (share of the padded area that is filled)."""
    return batches.groupBy("batch_id").agg(F.count("*").alias("n"), F.max(length).alias("longest"), F.round(F.sum(length) / (F.max(length) * F.count("*")), 6).alias("efficiency"))


def collated(batches: DataFrame, ids: str, pad: int = -1) -> DataFrame:
    """Arrays right-padded to the longest of their batch, with their own length."""
    longest = batches.groupBy("batch_id").agg(F.max(F.size(ids)).alias("_m"))
    return batches.join(longest, "batch_id").withColumn("length", F.size(ids)).withColumn(ids, F.concat(F.col(ids), F.array_repeat(F.lit(pad).cast("long"), F.col("_m") - F.size(ids)))).drop("_m")
