"""Reading tables, the shared scratch folder, written intermediate tables, row numbers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_OWN_SCRATCH: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh path in the folder that all executors share (``spark.checkpoint.dir``).

    Only where that setting is missing and all tasks run in this process, as in tests, a temporary folder is made."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN_SCRATCH:
            _OWN_SCRATCH.append("file://" + tempfile.mkdtemp(prefix="speechlake-"))
        base = _OWN_SCRATCH[0]
    return f"{base.rstrip('/')}/speechlake-{uuid.uuid4().hex}"


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """df as a table in the shared folder: lineage ends there and lost executors cost nothing.

    The shuffle files behind it go at once, else they stay until the driver happens to collect its garbage."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._sl_path = path
    for kept in _OPEN:
        kept.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by ``written`` that nothing reads any more. Others are left alone."""
    for df in tables:
        path = df.__dict__.pop("_sl_path", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_OPEN: list[list[DataFrame]] = []


@contextmanager
def remembered(into: list[DataFrame]):
    """Adds every table that is written inside to the list, for ``discard`` once the result is safe."""
    _OPEN.append(into)
    try:
        yield into
    finally:
        _OPEN.pop()


def numbered(df: DataFrame, order: Sequence[str], to: str, group: str | Sequence[str] = ()) -> DataFrame:
    """Adds ``to``: 0, 1, 2, ... in ``order`` (within each ``group``), with no single task over all rows.

    Range partitions are sorted, each row gets its place in its partition, and the (few) partition
    counts give the offsets. Rows equal in ``order`` get neighbouring numbers in some order."""
    group = [group] if isinstance(group, str) else list(group)
    keys = [*group, *order]
    part, cut = F.shiftright("_sl_row", 33), ["_sl_part", *group]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = written(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_sl_row", F.monotonically_increasing_id())).withColumn("_sl_part", part)
    runs = rows.groupBy(*cut).agg(F.min("_sl_row").alias("_sl_lo"), F.count("*").alias("_sl_n"))
    before = W.partitionBy(*group).orderBy("_sl_part").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn("_sl_base", F.coalesce(F.sum("_sl_n").over(before), F.lit(0)))
    # runs has at most (partitions + groups) rows: without groups it may be broadcast, else Spark checks its size.
    runs = runs.drop("_sl_n").withColumnsRenamed({c: f"_sl_g_{c}" for c in cut})
    same = [F.col(c).eqNullSafe(F.col(f"_sl_g_{c}")) for c in cut]
    out = rows.join(F.broadcast(runs) if not group else runs, same).drop(*[f"_sl_g_{c}" for c in cut])
    return out.withColumn(to, F.col("_sl_row") - F.col("_sl_lo") + F.col("_sl_base")).drop("_sl_row", "_sl_part", "_sl_lo", "_sl_base")
