"""Run control over append-only logs: states, transitions, traces, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_per_stratum(rows: DataFrame, stratum: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each stratum with rank (from 1) and enough (whether the stratum has n)."""
    # Spark cuts each task's rows at the rank limit before the shuffle; the counts are combined map-side.
    top = rows.withColumn("_r", F.row_number().over(W.partitionBy(stratum).orderBy(*order))).where(F.col("_r") <= n)
    counts = rows.groupBy(F.col(stratum).alias("_s")).agg((F.count("*") >= n).alias("enough"))
    return top.join(counts, F.col(stratum).eqNullSafe(F.col("_s"))).withColumn("rank", F.col("_r").cast("long")).drop("_r", "_s")


def chain_audit(log: DataFrame, item: str, order: str, state: str, legal: DataFrame, start: str | None = None) -> DataFrame:
    """Steps of each item that the legal pairs (state, next_state) do not allow."""
    w = W.partitionBy(item).orderBy(order)
    steps = log.select(item, order, F.lag(state, 1, start).over(w).alias("state"), F.col(state).alias("next_state")).where("state is not null")
    return steps.join(legal, ["state", "next_state"], "left_anti")


def attempts(log: DataFrame, item: str, state: str, starts: list[str]) -> DataFrame:
    return log.groupBy(item).agg(F.count_if(F.col(state).isin(starts)).alias("attempts"))


def reached_then(log: DataFrame, item: str, order: str, first: Column, then: Column) -> DataFrame:
    """Items in which ``first`` happens and ``then`` happens later."""
    one = log.groupBy(item).agg(F.min(F.when(first, F.col(order))).alias("_a"), F.max(F.when(then, F.col(order))).alias("_b"))
    return one.where("_a < _b").select(item)


def next_item(items: DataFrame, by: list[str], order: str, ready: Column) -> DataFrame:
    """The first ready item of each run."""
    rest = [c for c in items.columns if c not in by]
    return items.where(ready).groupBy(*by).agg(F.min_by(F.struct(*rest), order).alias("_i")).select(*by, "_i.*")


def filled(rows: DataFrame, by: list[str], order: str, value: Column, to: str) -> DataFrame:
    """The last non-null value carried forward."""
    return rows.withColumn(to, F.last(value, ignorenulls=True).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)))


def sessions(rows: DataFrame, by: str, at: Column, order: list[str], gap: float) -> DataFrame:
    """rows with session: a new one where the gap to the row before exceeds ``gap`` seconds."""
    w = W.partitionBy(by).orderBy(*order)
    new = F.coalesce((at - F.lag(at).over(w) > gap).cast("long"), F.lit(0))
    return rows.withColumn("_n", new).withColumn("session", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_n")


def trace_differences(traces: DataFrame, run: str, step: str, value: str, reference, tolerance: float, anchors: list[int] = ()) -> DataFrame:
    """run, n (common steps), largest |difference| from the reference run over those, exceeding (the tolerance), missing
    (anchors that the run lacks, joined by commas; null if none)."""
    ref = traces.where(F.col(run) == reference).select(step, F.col(value).alias("_v"))
    d = F.abs(F.col(value) - F.col("_v"))
    lacks = F.array_except(F.array(*[F.lit(a) for a in sorted(anchors)]).cast("array<int>"), F.collect_set(F.when(F.col(step).isin(*anchors), F.col(step).cast("int"))))
    own = traces.where(F.col(run) != reference).join(ref, step, "left").groupBy(run)
    out = own.agg(F.count("_v").alias("n"), F.round(F.max(d), 6).alias("largest"), F.count_if(d > tolerance).alias("exceeding"), lacks.alias("_lacks"))
    return out.withColumn("missing", F.when(F.size("_lacks") > 0, F.array_join("_lacks", ","))).drop("_lacks")


#: Verdict -> (resume, selection, deployment prohibited, forensic preservation)
DISPOSITIONS = {
    "invalid_for_calibration": (True, True, True, True),
    "invalid_for_selection": (False, True, True, False),
    "forensic_only": (True, True, True, True),
    "valid": (False, False, False, False),
}


def dispositions(runs: DataFrame, verdict: Column) -> DataFrame:
    spark = runs.sparkSession
    table = spark.createDataFrame([(k, *v) for k, v in DISPOSITIONS.items()], "verdict string, resume_prohibited boolean, selection_prohibited boolean, deployment_prohibited boolean, forensic boolean")
    return runs.withColumn("verdict", verdict).join(F.broadcast(table), "verdict", "left")


def with_default(rows: DataFrame, table: DataFrame, key: str, fields: list[str], default: Column) -> DataFrame:
    """rows with fields of table by key; a key that the table lacks takes the default key's row."""
    known = table.select(F.col(key).alias("_known")).distinct()
    used = rows.join(known, F.col(key) == F.col("_known"), "left").withColumn("_use", F.coalesce("_known", default))
    return used.join(table.select(F.col(key).alias("_use"), *fields), "_use", "left").withColumn("used", F.col("_use")).drop("_use", "_known")
