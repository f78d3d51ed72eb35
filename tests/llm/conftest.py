import sys
from pathlib import Path

import pytest
from pyspark.sql import types as K

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

ODD = K.StructType([K.StructField("doc_id", K.LongType()), K.StructField("text", K.StringType()), K.StructField("lang", K.StringType()), K.StructField("source", K.StringType()), K.StructField("n_chars", K.LongType()), K.StructField("shard", K.StringType()), K.StructField("n_words", K.StringType()), K.StructField("_r", K.StringType())])


def rows(texts):
    return [(i, t, "en", "s", None if t is None else len(t), "x", None, "y") for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    long_text = " ".join(f"word{i % 977} a{i}" for i in range(20000))
    one = "the quick brown fox jumps over the lazy dog while seven wizards brew a potion of mint tea"
    texts = [(0, one), (1, one), (2, one), (2, one), (3, None), (4, ""), (5, " \n\t "), (6, long_text), (7, long_text + " end"), (8, "a b"), (9, one.upper()), (None, one), (None, None), (10, "x\x1fy\x85z <|endoftext|> ▁ é"), (11, one + "\n" + one + "\nshort line"), (12, one.replace("mint", "mind") + "\nnew line of its own with words enough to matter here")]
    extra = [(13, "plain words here", None, None, None, None, None, None)]
    return spark.createDataFrame(rows(texts) + extra, ODD).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], ODD)
