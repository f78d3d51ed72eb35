"""Sharding by vector bin packing.

Documents with equal texts form a group. A group is a vector (bytes, tokens, rows); it goes to the
shard where the dot product with the shard's residual capacity is highest. The law that holds is
``bytes``: shards have nearly equal sizes (a size: UTF-8 bytes of the text plus 1; null text: 1).

Groups of more than a quarter of a shard are split into pieces of about an eighth of a shard, else no
balance would exist. Units (groups or pieces) of more than 1/32 of a shard are at most 32 * shards
by construction; the driver places those one by one. All others are dealt by hash to cells of about a
thousand units, and each cell is packed on its own, against its share of what the large units left.

Null text: its own group, size 1, crc 0. Empty table: no rows. Repeated rows: kept, each with its slot. Null
doc_id: sorted first in its shard; of a split group all null ids are in one piece. Very long texts: a unit by
itself. Columns other than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, numbered, written

#: How much bytes, tokens and rows count in the dot product. Bytes lead, since the law binds them.
WEIGHTS = (1.0, 0.02, 0.02)


def place(vectors: np.ndarray, residual: np.ndarray, first: int = 0) -> np.ndarray:
    """Shard of each row of vectors, largest first; residual (shards x 3) is used up in place.

    Of equal shards the first one from ``first`` on is taken."""
    weights, n, out = np.array(WEIGHTS), len(residual), np.empty(len(vectors), dtype=np.int32)
    turn = (np.arange(n) + first) % n
    left = residual[turn]
    for i, v in enumerate(vectors * weights):
        s = int(np.argmax(left @ v))
        left[s] -= vectors[i]
        out[i] = turn[s]
    residual[turn] = left
    return out


def _cell_packer(residual: list[list[float]], light: Sequence[float]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["bytes", "_sl_key", "_sl_sub"], ascending=[False, True, True])
        v = pdf[["bytes", "tokens", "rows"]].to_numpy(dtype=float)
        total = np.maximum(np.array(light, dtype=float), 1)
        # The cell's share of the residual capacity, then all in units of the cell's totals.
        own = np.maximum(v.sum(axis=0), 1)
        left = np.array(residual, dtype=float) * (own / total) / own
        shard = place(v / own, left, first=int(pdf["_sl_cell"].iloc[0]) % len(left))
        return pd.DataFrame({"_sl_key": pdf["_sl_key"], "_sl_sub": pdf["_sl_sub"], "shard": shard})

    return pack


def shard(docs: DataFrame, shards: int = 16, text: str = "text", doc_id: str = "doc_id", cell: int = 1000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; slot is gapless in each shard, by doc_id."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = written(docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
        F.when(F.col(text).isNull(), F.lit("null")).otherwise(F.md5(t)).alias("_sl_key"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("_sl_tokens"),
    ))
    sums = [F.sum("size").alias("bytes"), F.sum("_sl_tokens").alias("tokens"), F.count("*").alias("rows")]
    groups = written(rows.groupBy("_sl_key").agg(*sums))
    bytes_, tokens, n_rows, n_groups = groups.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "rows")), F.count("*")).first()
    totals, capacity = np.array([bytes_, tokens, n_rows], dtype=float), max(1.0, bytes_ / shards)

    # At most 4 * shards groups are that large.
    spark = docs.sparkSession
    large = {r["_sl_key"]: int(-(-r["bytes"] // (capacity / 8))) for r in groups.where(F.col("bytes") > capacity / 4).select("_sl_key", "bytes").collect() if r["bytes"] > 0}
    split = spark.createDataFrame(sorted(large.items()), "_sl_key string, _sl_pieces int")
    rows = rows.join(F.broadcast(split), "_sl_key", "left").withColumn("_sl_sub", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("_sl_pieces").cast("long")), F.lit(0)).cast("int")).drop("_sl_pieces")
    whole = groups.join(F.broadcast(split), "_sl_key", "left_anti").select("_sl_key", F.lit(0).alias("_sl_sub"), "bytes", "tokens", "rows")
    pieces = rows.join(F.broadcast(split), "_sl_key", "left_semi").groupBy("_sl_key", "_sl_sub").agg(*sums)
    units = written(whole.unionByName(pieces))

    # At most 32 * shards units are that large.
    bound = capacity / 32
    heavy = units.where(F.col("bytes") > bound).toPandas().sort_values(["bytes", "_sl_key", "_sl_sub"], ascending=[False, True, True])
    safe = np.maximum(totals, 1)
    residual = np.tile(totals / safe / shards, (shards, 1))
    heavy["shard"] = place(heavy[["bytes", "tokens", "rows"]].to_numpy(dtype=float) / safe, residual)
    light = totals - heavy[["bytes", "tokens", "rows"]].to_numpy(dtype=float).sum(axis=0)
    cells = max(1, -(-int(n_groups) // cell))
    dealt = units.where(F.col("bytes") <= bound).withColumn("_sl_cell", F.pmod(F.xxhash64("_sl_key", "_sl_sub"), F.lit(cells)).cast("int"))
    packed = dealt.groupBy("_sl_cell").applyInPandas(_cell_packer((residual * safe).tolist(), light.tolist()), "_sl_key string, _sl_sub int, shard int")
    fixed: Iterable = [(r["_sl_key"], int(r["_sl_sub"]), int(r["shard"])) for _, r in heavy.iterrows()]
    where = packed.unionByName(spark.createDataFrame(list(fixed), "_sl_key string, _sl_sub int, shard int"))
    out = numbered(rows.join(written(where), ["_sl_key", "_sl_sub"]), ["doc_id", "_sl_key"], "slot", group="shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
