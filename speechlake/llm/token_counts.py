"""Token counts with the whole-token shortcut.

Offline (once a worker, from the model file alone) it is proved which vocabulary entries encode alone as
one token. A text is cut into pre-tokens (a run of spaces and what follows it up to the next space);
those that are such an entry count 1 directly, and only the rest is merged by the library, each distinct
one once. The cut is exact if no vocabulary entry has a word mark after another character, which is
checked when the model loads; a model that fails the check gets whole texts.

Null text: counts as empty, 0 tokens. Empty table: no rows. Repeated rows: each gets its count. Very long texts:
counted whole. Columns other than doc_id and text play no part, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import KEPT, Recent, once, slices

MARK = "▁"
_UNIT = re.compile(" *[^ ]+| +")


class PieceCounter:
    def __init__(self, file: str, kept: int = KEPT):
        import sentencepiece

        self.model, self.known = sentencepiece.SentencePieceProcessor(model_file=file), Recent(kept)
        size = self.model.get_piece_size()
        entries = [(i, self.model.id_to_piece(i)) for i in range(size) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        self.cuts_hold = not any(MARK in p.lstrip(MARK) for _, p in entries)
        words = [(i, p[1:]) for i, p in entries if len(p) > 1 and p[0] == MARK and p[1] != MARK]
        # Proof by the library itself: the entry's string, encoded alone, is that one id.
        self.single = {" " + w for (i, w), ids in zip(words, self.model.encode([w for _, w in words], num_threads=1), strict=True) if ids == [i]} if self.cuts_hold else set()

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts_hold:
            return [len(x) for x in self.model.encode(texts, num_threads=1)]
        known, units = self.known, []
        for t in texts:
            t = t.replace(MARK, " ")
            if not t:
                units.append([])
            elif "  " in t or t[0] == " " or t[-1] == " ":
                # A run of spaces belongs to the word after it; the library puts one before the text.
                units.append(_UNIT.findall(" " + t))
            else:
                units.append([" " + x for x in t.split(" ")])
        known.turn()
        single, rest = self.single, []
        for u in known.missing(set().union(*units)):
            if u in single or u == " ":
                known[u] = 1
            else:
                rest.append(u)
        known.update(zip(rest, map(len, self.model.encode([u[1:] for u in rest], num_threads=1)), strict=True))
        get = known.__getitem__
        return [sum(map(get, us)) for us in units]


def count(docs: DataFrame, file: str, limit: int = 4096, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; file: a sentencepiece model. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once((file, "pieces"), lambda: PieceCounter(file))
        for b in batches:
            sizes, counts = b.column("n_bytes").to_pylist(), []
            for lo, hi in slices(sizes):
                counts += counter.counts(b.column("text").slice(lo, hi - lo).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"), F.octet_length(t).cast("long").alias("n_bytes"))
    out = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
