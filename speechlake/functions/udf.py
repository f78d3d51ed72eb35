"""Plug-ins: tokenizer and metric registries, score-once cache, table functions for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from . import text as T
from . import vectorized as V

#: name -> (Column -> array column)
TOKENIZERS: dict[str, Callable[[Column], Column]] = {"char": T.characters, "byte": V.byte_tokens, "mixed": lambda c: V.mixed_tokenizer({})(c)}
METRICS: dict[str, Callable[[Column, Column], Column]] = {"cer": T.error_rate, "wer": T.word_error_rate}


def tokenizer(name: str) -> Callable[[Column], Column]:
    return TOKENIZERS[name]


def scored_once(rows: DataFrame, reference: str, hypothesis: str, metrics: list[str]) -> DataFrame:
    """Each distinct (reference, hypothesis) is scored once; scores are joined back by digest."""
    keyed = rows.withColumn("_k", F.sha2(F.concat_ws("\0", reference, hypothesis), 256))
    once = keyed.select("_k", reference, hypothesis).dropDuplicates(["_k"])
    return keyed.join(once.select("_k", *[METRICS[m](F.col(reference), F.col(hypothesis)).alias(m) for m in metrics]), "_k").drop("_k")


def scheduled(f: Callable[[float], float]):
    """A user's mixing schedule as a pandas UDF: DOUBLE -> DOUBLE."""

    @F.pandas_udf(K.DoubleType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(f).astype("float64")

    return run


def with_model(rows: DataFrame, schema: str, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]]) -> DataFrame:
    """Any model: made once a partition, applied to Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            yield model(pdf)

    return rows.mapInPandas(run, schema)


@F.udtf(returnType=K.StructType([K.StructField("chunk", K.IntegerType()), K.StructField("text", K.StringType())]))
class SentenceChunks:
    """Use: SELECT ... FROM t, LATERAL sentence_chunks(t.text, 135)."""

    def eval(self, text: str, most: int):
        for i, c in enumerate(V.chunks(text, most)):
            yield i, c


def register(spark: SparkSession) -> None:
    spark.udtf.register("sentence_chunks", SentenceChunks)
