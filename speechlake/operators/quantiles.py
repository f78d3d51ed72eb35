"""Exact quantiles by group through radix selection (U4, used by A7, A8, A10, A12).

A histogram of the leading part of each value by group shows in which bucket each wanted rank lies; only those buckets are
read again, and split again while they hold more than ``crowd`` values. All fractions, conditions and metrics share
the passes: two of them, as a rule. Rows are neither sorted nor numbered, and tasks send counts, not values, but for the
values of the last, small buckets.

The first buckets are those of sign and logarithm, later ones cut the range between a bucket's least and greatest value
evenly. Both maps keep the order of values (they may only map neighbours to one bucket), so ranks are exact.

Null values are left out; a group without values is not in the result. NaN is above all numbers. Null groups are groups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..tables import discard, written

#: Buckets into which a later round cuts one.
PIECES = 4096
#: Buckets for each factor of e in the first round.
_FINE = 64


@dataclass(frozen=True)
class Quantile:
    """sorted[round((n - 1) * fraction)], half to even; with ``linear`` between the two values around (n - 1) * fraction.

    ``where`` says which rows count."""

    value: str
    fraction: float
    linear: bool = False
    where: Column | None = None

    def ranks(self, n: Column) -> list[Column]:
        at = (n - 1) * F.lit(float(self.fraction))
        return [F.floor(at).cast("long"), F.ceil(at).cast("long")] if self.linear else [F.bround(at).cast("long")]


def _leading(v: Column) -> Column:
    """The bucket of a value by its sign and logarithm; never smaller for a larger value."""
    d = v.cast("double")
    size = lambda x: 1_000_000 + F.floor(F.log(x) * _FINE)
    return F.when(F.isnan(d), 1 << 40).when(d == float("inf"), 1 << 39).when(d == float("-inf"), -(1 << 39)).when(d > 0, size(d)).when(d < 0, -size(-d)).otherwise(0).cast("long")


def _held(ranks: Column, before: Column, n: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= before) & (r < before + n))


def quantiles(rows: DataFrame, by: list[str], picks: dict[str, Quantile], crowd: int = 4096) -> DataFrame:
    """by and a column for each of the picks."""
    groups = [f"_g{i}" for i in range(len(by))]
    measures = list(dict.fromkeys((p.value, str(p.where)) for p in picks.values()))
    of = {name: measures.index((p.value, str(p.where))) for name, p in picks.items()}
    which = {of[name]: p for name, p in picks.items()}
    values = [F.struct(F.lit(m).alias("_m"), (F.col(p.value) if p.where is None else F.when(p.where, F.col(p.value))).alias("_v")) for m, p in sorted(which.items())]
    long = rows.select(*[F.col(c).alias(g) for c, g in zip(by, groups, strict=True)], F.explode(F.array(*values)).alias("_e"))
    long = long.select(*groups, "_e._m", "_e._v").where("_v is not null")
    spread = [F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    key = [*groups, "_m"]
    histogram = long.groupBy(*key, _leading(F.col("_v")).alias("_b")).agg(*spread)
    whole = W.partitionBy(*key)
    below = lambda *cut: F.coalesce(F.sum("_n").over(W.partitionBy(*key, *cut).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = F.array().cast("array<bigint>")
    for m in range(len(measures)):
        own = [r for name, p in picks.items() if of[name] == m for r in p.ranks(F.col("_total"))]
        ranks = F.when(F.col("_m") == m, F.array_distinct(F.array(*own))).otherwise(ranks)
    placed = histogram.withColumn("_total", F.sum("_n").over(whole)).withColumn("_before", below())
    columns = [*key, "_total", "_before", "_n", "_lo", "_hi", "_ranks"]
    found = written(placed.withColumn("_ranks", _held(ranks, F.col("_before"), F.col("_n"))).where(F.size("_ranks") > 0).select(*columns))
    unlike = F.col("_lo") < F.col("_hi")

    def read(open_: DataFrame) -> DataFrame:
        """The values in open buckets, with the bucket's columns (_o_...). Buckets of a group don't overlap."""
        there = open_.withColumnsRenamed({c: f"_o{c}" for c in columns})
        same = [F.col(c).eqNullSafe(F.col(f"_o{c}")) for c in key]
        return long.join(there, [*same, F.col("_v") >= F.col("_o_lo"), F.col("_v") <= F.col("_o_hi")])

    while not found.where(unlike & (F.col("_n") > crowd)).isEmpty():
        cut = read(found.where(unlike & (F.col("_n") > crowd)))
        share = (F.col("_v") - F.col("_o_lo")).cast("double") / (F.col("_o_hi") - F.col("_o_lo")).cast("double")
        kept = ["_o_lo", "_o_total", "_o_before", "_o_ranks"]
        parts = cut.groupBy(*key, *kept, F.least(F.floor(share * PIECES), F.lit(PIECES - 1)).alias("_b")).agg(*spread)
        parts = parts.withColumn("_before", F.col("_o_before") + below("_o_lo")).withColumn("_ranks", _held(F.col("_o_ranks"), F.col("_before"), F.col("_n")))
        parts = parts.where(F.size("_ranks") > 0).withColumnRenamed("_o_total", "_total").select(*columns)
        last, found = found, written(found.where(~(unlike & (F.col("_n") > crowd))).unionByName(parts))
        discard(last)
    # At most ``crowd`` values a bucket.
    small = read(found.where(unlike)).groupBy(*key, "_o_lo", "_o_total", "_o_before", "_o_ranks").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
    small = small.select(*key, F.col("_o_total").alias("_total"), F.explode("_o_ranks").alias("_r"), "_all", "_o_before")
    small = small.select(*key, "_total", "_r", F.get("_all", (F.col("_r") - F.col("_o_before")).cast("int")).alias("_v"))
    points = found.where(~unlike).select(*key, "_total", F.explode("_ranks").alias("_r"), F.col("_lo").alias("_v")).unionByName(small)
    out = []
    for name, p in picks.items():
        at, own = p.ranks(F.col("_total")), F.col("_m") == of[name]
        value = lambda r, own=own: F.max(F.when(own & (F.col("_r") == r), F.col("_v")))
        if p.linear:
            share = F.max(F.when(own, (F.col("_total") - 1) * F.lit(float(p.fraction)) - at[0]))
            out.append((value(at[0]) * (1 - share) + value(at[1]) * share).alias(name))
        else:
            out.append(value(at[0]).alias(name))
    return points.groupBy(*groups).agg(*out).withColumnsRenamed(dict(zip(groups, by, strict=True)))


def nearest_rank(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    return quantiles(rows, by, {name: Quantile(value, f) for name, f in fractions.items()})


def interpolated(rows: DataFrame, by: list[str], value: str, fractions: dict[str, float]) -> DataFrame:
    return quantiles(rows, by, {name: Quantile(value, f, linear=True) for name, f in fractions.items()})
