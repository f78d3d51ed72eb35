"""Token ids as a binary table: fixed-size blocks, split into byte or bit planes, each plane zstd-compressed.

``write`` orders the documents by doc_id over range partitions, encodes them, and cuts each partition's
ids into groups of whole documents. A group's ids are cut into blocks of ``block`` ids (the last may be
shorter). A block is transposed: plane k holds byte (or bit) k of each of its ids; every plane is
compressed alone, so the planes of high bytes, all zero, cost a few bytes. Spark's own writer commits
the groups (a lost executor's half-written files never show), in rows of

    part int, grp int, first long (ids before it in its part), n_ids long, doc_id array<long>, n_tokens array<long>,
    block int, planes int, plane_bytes array<int> (the chunk index), crc32 long, payload binary

plane_bytes lists the compressed sizes block by block, plane by plane: a reader finds any block by a sum.
``read`` gives back (doc_id, start, n_tokens, ids as little-endian uint32); start counts all ids before.

Null text: the empty document, which has only the end id. Null doc_id: sorted first. Repeated rows: all
kept, in order of their text hash. Empty table: an empty file. Very long texts: a group of their own, encoded
whole. Columns other than doc_id and text are not written, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tokens import encoder, slices

SCHEMA = "part int, grp int, first long, n_ids long, doc_id array<long>, n_tokens array<long>, block int, planes int, plane_bytes array<int>, crc32 long, payload binary"
BLOCK = 65_536
#: A group closes when it holds that many ids; a longer document is a group of its own.
GROUP = 1 << 20


def to_planes(ids: np.ndarray, block: int = BLOCK, planes: int = 4, level: int = 3) -> tuple[bytes, list[int]]:
    """(payload, compressed size of each plane of each block); planes: 4 (bytes) or 32 (bits)."""
    import zstandard

    packer, out, sizes = zstandard.ZstdCompressor(level=level), [], []
    for lo in range(0, len(ids), block):
        rows = ids[lo : lo + block].astype("<u4").view(np.uint8).reshape(-1, 4)
        if planes == 32:
            rows = np.packbits(np.unpackbits(rows, axis=1, bitorder="little"), axis=0, bitorder="little")
        for plane in np.ascontiguousarray(rows.T):
            out.append(packer.compress(plane.tobytes()))
            sizes.append(len(out[-1]))
    return b"".join(out), sizes


def from_planes(payload: bytes, sizes: list[int], n_ids: int, block: int = BLOCK, planes: int = 4) -> np.ndarray:
    import zstandard

    unpacker, out, at, left = zstandard.ZstdDecompressor(), [], 0, n_ids
    for k in range(0, len(sizes), planes):
        n, rows = min(block, left), []
        for size in sizes[k : k + planes]:
            raw = n if planes == 4 else (n + 7) // 8
            rows.append(np.frombuffer(unpacker.decompress(payload[at : at + size], max_output_size=max(raw, 1)), dtype=np.uint8))
            at += size
        grid = np.ascontiguousarray(np.array(rows).T)
        if planes == 32:
            grid = np.packbits(np.unpackbits(grid, axis=0, count=n, bitorder="little"), axis=1, bitorder="little")
        out.append(np.ascontiguousarray(grid).view("<u4").ravel())
        left -= n
    return np.concatenate(out) if out else np.empty(0, dtype="<u4")


def _groups(file: str, kind: str, end_id: int | None, block: int, planes: int):
    from pyspark import TaskContext

    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def row(part: int, grp: int, first: int, docs: list, ids: list[bytes]) -> pa.RecordBatch:
        flat = np.frombuffer(b"".join(ids), dtype="<u4")
        payload, sizes = to_planes(flat, block, planes)
        values = [[part], [grp], [first], [len(flat)], [docs], [[len(x) // 4 for x in ids]], [block], [planes], [sizes], [zlib.crc32(flat.tobytes())], [payload]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, grp, first, docs, ids, held = encoder(file, kind), TaskContext.get().partitionId(), 0, 0, [], [], 0
        for b in batches:
            names, texts = b.column("doc_id").to_pylist(), b.column("text")
            for lo, hi in slices(b.column("_sl_size").to_pylist()):
                for doc, x in zip(names[lo:hi], enc.ids_of(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    docs.append(doc)
                    ids.append(x + end)
                    held += len(ids[-1]) // 4
                    if held >= GROUP:
                        yield row(part, grp, first, docs, ids)
                        grp, first, docs, ids, held = grp + 1, first + held, [], [], 0
        if docs:
            yield row(part, grp, first, docs, ids)

    return run


def write(docs: DataFrame, path: str, file: str, kind: str = "byte", end_id: int | None = 0, block: int = BLOCK, planes: int = 4, text: str = "text", doc_id: str = "doc_id", partitions: int | None = None) -> None:
    """Writes the documents' ids to path, in ascending doc_id order over ascending (part, grp)."""
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.octet_length(t).alias("_sl_size"), F.xxhash64(t).alias("_sl_hash"))
    order = ["doc_id", "_sl_hash"]
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_sl_hash")
    # The planes are compressed already.
    rows.mapInArrow(_groups(file, kind, end_id, block, planes), SCHEMA).write.option("compression", "none").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document; each group's crc is checked. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for g in b.to_pylist():
                raw = from_planes(g["payload"], g["plane_bytes"], g["n_ids"], g["block"], g["planes"]).tobytes()
                if zlib.crc32(raw) != g["crc32"]:
                    raise ValueError(f"part {g['part']}, group {g['grp']}: ids differ from those written")
                ends = np.cumsum(g["n_tokens"]).tolist()
                begins = [0, *ends[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([g["part"]] * len(ends), pa.int32()), pa.array(g["doc_id"], pa.int64()), pa.array([g["first"] + x for x in begins], pa.int64()),
                        pa.array(g["n_tokens"], pa.int64()), pa.array([raw[4 * lo : 4 * hi] for lo, hi in zip(begins, ends, strict=True)], pa.binary()),
                    ],
                    names=["part", "doc_id", "start", "n_tokens", "ids"],
                )

    chunks = spark.read.schema(SCHEMA).parquet(path)
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # From the index alone; one row for each write task, so it may be broadcast.
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("_sl_n")).select("part", F.coalesce(F.sum("_sl_n").over(before), F.lit(0)).alias("_sl_first"))
    docs = chunks.mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(parts), "part").select("doc_id", (F.col("start") + F.col("_sl_first")).alias("start"), "n_tokens", "ids")
