import random

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators use inside
    + [T.StructField(n, T.StringType()) for n in ("row", "score", "fp", "key", "piece", "start", "kept", "n", "lang_pred", "component_id", "m")]
)


def edge_rows():
    rng = random.Random(3)
    words = ["the", "of", "Thing", "haus", "straße", "été", "ñandú", "and,", "x.", "###", "|", "12", "don't", "Σίσυφος", "中文字"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = prose(40_000)
    texts = [None, "", " \n\t ", "one", "two words", "a a a a a a a a", prose(60), prose(200), "line\nline\n\nline x\nline", "<|endoftext|> x<|endoftext|>y <|ENDOFTEXT|>", "A\u0301\u00a0b\u2003c\x1cd\x85e", "\\<s>[INST]</s>", "é" * 700, "x" * 5_000, long, long + " end", prose(51), "!!! ### $$$", "1 2 3", "\U0001f600 emoji \U0001f600"]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (6, "another text with the number six"), (None, texts[7]), (None, None), (100, texts[6]), (101, texts[7] + " tail"), (-5, texts[7])]
    return [(k, t, rng.choice(["en", "fr", None]), None, None if t is None else len(t), *(["c"] * 11)) for k, t in rows]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()
