"""Sinks: sharded tables with a manifest, results with a headline, one file a row."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregate import manifest, root_digest, shards
from ..tables import discard, written


def _digest(columns: list[str]) -> Column:
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def _manifest(sharded: DataFrame, columns: list[str]) -> DataFrame:
    return manifest(sharded.select("shard_id", "position", _digest(columns).alias("row_digest")), "row_digest")


def _write_files(sharded: DataFrame, path: str, size: int) -> DataFrame:
    """One file a shard: a range of whole shards is a task, sorted, and a file ends after size rows. Gives what was written."""
    sharded.repartitionByRange(F.col("shard_id")).sortWithinPartitions("position").write.option("maxRecordsPerFile", size).parquet(path)
    return sharded.sparkSession.read.schema(sharded.schema).parquet(path)


def write_shards(rows: DataFrame, path: str, order: list[str], size: int) -> DataFrame:
    """Writes rows in order, size rows a shard, one file each; gives the manifest of what was written.
    An existing path is an error; Spark commits all shards or none."""
    return _manifest(_write_files(shards(rows, order, size), path, size), rows.columns)


#: The one file that publishes, and what a folder of data is called.
MARKER, DATA = "_PUBLISHED", "data-"


class Store:
    """A folder in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.files.listStatus(self._at(""))) if self.files.exists(self._at("")) else []

    def delete(self, name: str) -> None:
        self.files.delete(self._at(name), True)

    def move(self, name: str, to: str) -> bool:
        return bool(self.files.rename(self._at(name), self._at(to)))

    def write(self, name: str, text: str) -> None:
        out = self.files.create(self._at(name), False)
        out.write(bytearray(text.encode()))
        out.close()

    def read(self, name: str) -> str | None:
        if not self.files.exists(self._at(name)):
            return None
        # Spark's readers leave out names that begin with an underscore.
        into = self.files.open(self._at(name))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(into, "UTF-8")
        into.close()
        return text


def publish(rows: DataFrame, path: str, order: list[str], size: int) -> DataFrame:
    """The manifest (shard_id, n_rows, digest, file) of rows published in path: all of them or none, once.

    Digests are computed first. If the marker names the same root digest, nothing is written. If it names another, that is
    an error. Else shards and manifest go to a staged folder, are read back and compared with the digests, and the folder
    gets its name, that of the root digest; the marker, renamed into place last, publishes it. Before that no reader
    finds anything (``published`` reads through the marker), and what a crash has left goes with the next run."""
    spark, store = rows.sparkSession, Store(rows.sparkSession, path)
    sharded = written(shards(rows, order, size))
    own = written(_manifest(sharded, rows.columns))
    root = root_digest(own)
    name = f"{DATA}{root}"
    found = store.read(MARKER)
    if found is None:
        for left in store.names():
            store.delete(left)
        staged = f"_staged-{uuid.uuid4().hex}"
        back = _write_files(sharded, f"{store.path}/{staged}/rows", size)
        files = back.select("shard_id", F.regexp_extract(F.input_file_name(), "[^/]+$", 0).alias("file")).groupBy("shard_id").agg(F.min("file").alias("file"))
        _manifest(back, rows.columns).join(files, "shard_id").write.parquet(f"{store.path}/{staged}/manifest")
        got = root_digest(spark.read.parquet(f"{store.path}/{staged}/manifest"))
        if got != root:
            raise OSError(f"shards read back from {path} have digest {got}, not {root}")
        if not store.move(staged, name):
            raise OSError(f"{staged} could not be renamed to {name} in {path}")
        mark = f"_marker-{uuid.uuid4().hex}"
        store.write(mark, root)
        if not store.move(mark, MARKER):
            # Another run was first.
            store.delete(mark)
        found = store.read(MARKER)
    discard(sharded, own)
    if found != root:
        raise FileExistsError(f"{path} holds digest {found}, not {root}")
    return published(spark, path)[1]


def published(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, manifest) of a published path; FileNotFoundError if there is no marker."""
    root = Store(spark, path).read(MARKER)
    if root is None:
        raise FileNotFoundError(f"nothing is published in {path}")
    where = f"{path.rstrip('/')}/{DATA}{root}"
    return spark.read.parquet(f"{where}/rows"), spark.read.parquet(f"{where}/manifest")


def write_results(rows: DataFrame, path: str, metric: str, digits: int) -> DataFrame:
    """Rows as JSON lines; the headline (count and mean) is a one-row frame."""
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path).agg(F.count(metric).alias("n"), F.round(F.avg(metric), digits).alias("mean"))


def write_files(rows: DataFrame, path: str) -> str:
    """A file ``name`` with the content ``body`` (text or bytes) in path for each row; gives path back.

    Tasks write through Arrow's file systems (file, hdfs, s3, gs); a task that runs again writes the same files."""
    where = path if ":" in path else f"file://{path}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow.fs import FileSystem

        store, top = FileSystem.from_uri(where)
        store.create_dir(top, recursive=True)
        for pdf in batches:
            for name, body in zip(pdf["name"], pdf["body"], strict=True):
                with store.open_output_stream(f"{top}/{name}") as f:
                    f.write(body.encode() if isinstance(body, str) else bytes(body))
            yield pd.DataFrame({"n": [len(pdf)]})

    rows.select("name", "body").mapInPandas(run, "n long").agg(F.sum("n")).first()
    return path
