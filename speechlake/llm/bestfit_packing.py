"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens. Pieces of full length are sequences of their own.
The others are dealt by hash to cells; each cell packs its pieces by best-fit decreasing and computes
lower bounds of its number of bins from dual feasible functions (the L2 bound of Martello and Toth, and
the functions u_k of Fekete and Schepers). A cell whose count equals its bound is certified: its bins
stay, but for the emptiest one. A cell with a gap keeps only its full bins. All other pieces go back and
are dealt again, to fewer cells, so cells exchange documents and rerun; the rounds end when one cell held
all that was left, or after ``rounds``. Cells hold some ten thousand narrow rows; texts never move.

Null text: only the end id. Null doc_id: packed like any other. Repeated rows: packed each. Empty table:
no rows. Very long texts: encoded whole, cut into full pieces. Columns of ``pack``'s items that are named like the
new ones (sequence_id, offset, round, cell_bins, cell_bound) are replaced by these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder, slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, file: str, kind: str = "word", end_id: int | None = 0, capacity: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every document's ids, cut only if they are more than ``capacity``. No shuffle."""
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, step = encoder(file, kind), 4 * capacity
        for b in batches:
            names, texts, rows = b.column("doc_id").to_pylist(), b.column("text"), []
            for lo, hi in slices(b.column("_sl_size").to_pylist()):
                for doc, ids in zip(names[lo:hi], enc.ids_of(texts.slice(lo, hi - lo).to_pylist()), strict=True):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])

    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.octet_length(t).alias("_sl_size")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length, in the order given (descending for best-fit decreasing).

    Open bins wait in one stack for each residual; a bit set tells which stacks hold bins."""
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    there, n, bins, offsets = 0, 0, np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    for i, x in enumerate(lengths.tolist()):
        fit = there >> x
        if fit:
            r = x + (fit & -fit).bit_length() - 1
            stack = open_[r]
            k = stack.pop()
            if not stack:
                there ^= 1 << r
        else:
            k, r = n, capacity
            n += 1
        bins[i], offsets[i] = k, capacity - r
        if r > x:
            if not open_[r - x]:
                there |= 1 << (r - x)
            open_[r - x].append(k)
    return bins, offsets


def least_bins(lengths: np.ndarray, capacity: int, most_k: int = 24) -> int:
    """The best lower bound of the number of bins among the dual feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    sizes = np.arange(capacity + 1)
    n_up, sum_up = np.cumsum(count), np.cumsum(count * sizes)  # of lengths up to x
    total, half = int(sum_up[-1]), capacity // 2
    best = -(-total // capacity)
    # L2: for each e, lengths over capacity - e count as bins, those under e not at all.
    e = np.arange(half + 1)
    large = n_up[-1] - n_up[capacity - e]
    middle, middle_sum = n_up[capacity - e] - n_up[half], sum_up[capacity - e] - sum_up[half]
    small_sum = sum_up[half] - np.r_[0, sum_up[:half]]
    best = max(best, int((large + middle + np.maximum(0, -(-(small_sum - (middle * capacity - middle_sum)) // capacity))).max()))
    for k in range(1, most_k + 1):
        up = (k + 1) * sizes
        # u_k times k * capacity: whole multiples stay, others are rounded down.
        value = np.where(up % capacity == 0, k * sizes, capacity * (up // capacity))
        best = max(best, int(-(-int((value * count).sum()) // (k * capacity))))
    return best


def _packer(capacity: int, last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "_sl_item"], ascending=[False, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        bins, offsets = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths).astype(np.int64)
        bound = least_bins(lengths, capacity)
        if last:
            keep = np.ones(len(fill), dtype=bool)
        elif len(fill) == bound:
            keep = np.arange(len(fill)) != int(np.argmin(fill))
            keep |= fill == capacity
        else:
            keep = fill == capacity
        return pdf.assign(_sl_bin=bins, offset=offsets, _sl_keep=keep[bins], _sl_bins=len(fill), _sl_bound=bound)

    return run


def pack(items: DataFrame, capacity: int = 2048, cell: int = 20_000, rounds: int = 6) -> DataFrame:
    """items (length long, others stay) -> with sequence_id, offset, round, and the cell's bins and bound."""
    items = items.drop("sequence_id", "offset", "round", "cell_bins", "cell_bound")
    stored = written(items.withColumn("_sl_item", F.monotonically_increasing_id()))
    none = [F.lit(0).cast("long").alias("offset"), F.lit(-1).alias("round"), F.lit(1).cast("long").alias("cell_bins"), F.lit(1).cast("long").alias("cell_bound")]
    columns = [c for c in stored.columns if c != "_sl_item"]
    out = stored.where(F.col("length") >= capacity).select(*columns, (-1 - F.col("_sl_item")).alias("sequence_id"), *none)
    pool, left = stored.where(F.col("length") < capacity), None
    for r in range(rounds):
        left = pool.count()
        if not left:
            break
        cells = max(1, left // cell)
        last = cells == 1 and r > 0 or r == rounds - 1 or left <= cell
        dealt = pool.withColumn("_sl_cell", F.pmod(F.xxhash64("_sl_item", F.lit(r)), F.lit(cells)).cast("int"))
        kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
        done = written(dealt.groupBy("_sl_cell").applyInPandas(_packer(capacity, last), f"{kinds}, _sl_bin long, offset long, _sl_keep boolean, _sl_bins long, _sl_bound long"))
        sequence = F.shiftleft(F.lit(r).cast("long"), 58) + F.shiftleft(F.col("_sl_cell").cast("long"), 28) + F.col("_sl_bin")
        out = out.unionByName(done.where("_sl_keep").select(*columns, sequence.alias("sequence_id"), "offset", F.lit(r).alias("round"), F.col("_sl_bins").alias("cell_bins"), F.col("_sl_bound").alias("cell_bound")))
        if last:
            break
        pool = done.where("not _sl_keep").select(*stored.columns)
    return out


def pack_documents(docs: DataFrame, file: str, kind: str = "word", end_id: int | None = 0, capacity: int = 2048, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    return pack(pieces(docs, file, kind, end_id, capacity, text, doc_id), capacity)
