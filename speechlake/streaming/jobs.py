"""Structured Streaming jobs over event logs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from ..tables import scratch


def stream_of(spark: SparkSession, path: str, schema, max_files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def finished(df: DataFrame, mode: str, key: list[str] | None = None, order: str | None = None) -> DataFrame:
    """Runs the stream over all that has arrived and gives its result: every batch goes to Parquet with its
    number; for update mode the last version of each key counts."""
    spark, out, state = df.sparkSession, scratch(df.sparkSession), scratch(df.sparkSession)

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{out}/n={number}")

    df.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    columns, schema = df.columns, StructType([*df.schema.fields, StructField("_batch", LongType())])
    rows = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(out)
    if not key:
        return rows.drop("_batch")
    rest = [c for c in columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "_batch").alias("_r")).select(*key, "_r.*")


def latest_status(events: DataFrame, job: str, order: str, fields: list[str]) -> DataFrame:
    """Continuously the last record of each job; one row of state a job."""
    return events.groupBy(job).agg(F.max_by(F.struct(order, *fields), order).alias("_r")).select(job, "_r.*")


def stateful(spark: SparkSession) -> None:
    """Keyed state with timers is kept in RocksDB: on disk, with only what a batch touches in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _in_order(frames: Iterator[pd.DataFrame], order: str, codes: dict[str, dict]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The order column and the others of an item's rows in one batch, sorted: arrays of numbers, frame by frame, never
    one frame of rows. Text columns become codes; codes[column] maps a text to its code and grows."""
    kept: dict[str, list[np.ndarray]] = {}
    for pdf in frames:
        for c in pdf.columns:
            if c in codes:
                of = codes[c]
                kept.setdefault(c, []).append(np.fromiter((of.setdefault(x, len(of)) for x in pdf[c]), dtype=np.int32, count=len(pdf)))
            else:
                kept.setdefault(c, []).append(pdf[c].to_numpy())
    columns = {c: np.concatenate(v) for c, v in kept.items()}
    at = np.argsort(columns[order], kind="stable")
    return columns[order][at], {c: v[at] for c, v in columns.items() if c != order}


class ChainValidator(StatefulProcessor):
    """steps, illegal, attempts and last of an item, carried from batch to batch in one value."""

    def __init__(self, item: str, order: str, state: str, legal: set[tuple[str, str]], starts: set[str]):
        self.item, self.order, self.state, self.legal, self.starts = item, order, state, legal, starts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "steps long, illegal long, attempts long, last string")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        steps, illegal, attempts, last = self.seen.get() if self.seen.exists() else (0, 0, 0, None)
        codes: dict[Any, int] = {} if last is None else {last: 0}
        _, columns = _in_order((pdf[[self.order, self.state]] for pdf in rows), self.order, {self.state: codes})
        now = columns[self.state]
        names = list(codes)
        allowed = np.array([[(a, b) in self.legal for b in names] for a in names])
        chain = now if last is None else np.r_[np.int32(0), now]
        steps += len(chain) - 1
        illegal += int((~allowed[chain[:-1], chain[1:]]).sum())
        attempts += int(np.array([x in self.starts for x in names])[now].sum())
        last = names[now[-1]]
        self.seen.update((steps, illegal, attempts, last))
        yield pd.DataFrame({self.item: [key[0]], "steps": [steps], "illegal": [illegal], "attempts": [attempts], "last": [last]})

    def close(self) -> None:
        pass


def validate_chains(events: DataFrame, item: str, order: str, state: str, legal: set[tuple[str, str]], starts: set[str]) -> DataFrame:
    """Per item: steps seen, illegal steps, attempts (starts), last state; events are taken in order within a
    batch, and batches in the order of arrival. A batch's rows of one item are held as numbers; ``maxFilesPerTrigger``
    bounds a batch."""
    stateful(events.sparkSession)
    schema = f"{item} long, steps long, illegal long, attempts long, last string"
    return events.select(item, order, state).groupBy(item).transformWithStateInPandas(ChainValidator(item, order, state, legal, starts), schema, "Update", "None")


#: A lease lasts from a minute to a week, in seconds.
LEASE_SECONDS = (60, 7 * 24 * 3600)


class LeaseArbiter(StatefulProcessor):
    """The holder of an item's lease. A timer at the lease's end removes it once the watermark passes."""

    def __init__(self, item: str, order: str, owner: str, at: str, ttl: float, timed: bool):
        self.item, self.order, self.owner, self.at, self.ttl, self.timed = item, order, owner, at, ttl, timed

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lease = handle.getValueState("lease", "holder string, expires double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        holder, expires = self.lease.get() if self.lease.exists() else (None, float("-inf"))
        codes: dict[Any, int] = {}
        order, columns = _in_order((pdf[[self.order, self.owner, self.at]] for pdf in rows), self.order, {self.owner: codes})
        before, held = expires, -1 if holder is None else codes.setdefault(holder, len(codes))
        asked, at = columns[self.owner], columns[self.at].astype(float)
        granted = np.zeros(len(order), dtype=bool)
        for i, (own, now) in enumerate(zip(asked.tolist(), at.tolist(), strict=True)):
            if held < 0 or expires <= now or held == own:
                granted[i], held, expires = True, own, now + self.ttl
        names = list(codes)
        self.lease.update((names[held] if held >= 0 else None, expires))
        if self.timed and expires != before:
            if before != float("-inf"):
                self.handle.deleteTimer(self._end(before))
            self.handle.registerTimer(self._end(expires))
        for lo in range(0, len(order), 10_000):
            hi = lo + 10_000
            yield pd.DataFrame({self.item: key[0], self.order: order[lo:hi], self.owner: [names[k] for k in asked[lo:hi]], "granted": granted[lo:hi]})

    @staticmethod
    def _end(expires: float) -> int:
        return math.ceil(expires * 1000)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        # A lease that was extended has a later timer.
        if self.lease.exists() and self._end(self.lease.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.lease.clear()
        return iter(())

    def close(self) -> None:
        pass


def arbitrate_leases(requests: DataFrame, item: str, order: str, owner: str, at: str, ttl: float, ts: str | None = None) -> DataFrame:
    """Every request with granted: the lease is free, expired (expires <= now) or already the owner's.

    With ``ts``, a column with a watermark, a timer ends a lease once the watermark passes its end. ``ttl`` is in
    seconds, from a minute to a week."""
    if not LEASE_SECONDS[0] <= ttl <= LEASE_SECONDS[1]:
        raise ValueError(f"a lease lasts {LEASE_SECONDS[0]} to {LEASE_SECONDS[1]} seconds, not {ttl}")
    stateful(requests.sparkSession)
    rows = requests.select(item, order, owner, at, *([ts] if ts else [])).groupBy(item)
    return rows.transformWithStateInPandas(LeaseArbiter(item, order, owner, at, ttl, ts is not None), f"{item} long, {order} long, {owner} string, granted boolean", "Append", "EventTime" if ts else "None")


def interval_rates(events: DataFrame, ts: str, failed, width: str, late: str, slide: str | None = None) -> DataFrame:
    """Events and failures by tumbling (or sliding) interval; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width, slide)).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed")).select(F.col("window.start").alias("start"), "n", "failed")


def first_copies(events: DataFrame, ts: str, keys: list[str], late: str) -> DataFrame:
    """Repeated rows within the watermark go."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def merged_winners(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, winner struct<order>, n) of all that has arrived: the least row of each key, with the number of rows.

    Every batch adds its own winners under its number (a batch that runs again replaces them); least rows and counts
    merge in any order, so nothing that came before is written again."""
    spark, out = rows.sparkSession, scratch(rows.sparkSession)
    part = lambda b: b.groupBy(*keys).agg(F.min(F.struct(*order)).alias("winner"), F.count("*").alias("n"))

    def merge(batch: DataFrame, number: int) -> None:
        part(batch).write.mode("overwrite").parquet(f"{out}/n={number}")

    state = scratch(spark)
    rows.select(*dict.fromkeys([*keys, *order])).writeStream.foreachBatch(merge).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    found = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return found.groupBy(*keys).agg(F.min("winner").alias("winner"), F.sum("n").alias("n"))


def activity_sessions(events: DataFrame, ts: str, by: str, gap: str, late: str) -> DataFrame:
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap), by).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def off_trace(events: DataFrame, reference: DataFrame, key: str, value: str, expected: str, tolerance: float) -> DataFrame:
    """Stream rows whose value differs from the reference trace by more than the tolerance."""
    return events.join(reference.select(key, expected), key).where(F.abs(F.col(value) - F.col(expected)) > tolerance)
