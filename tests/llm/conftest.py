import os
import random

import pytest
from pyspark.sql import types as T

SF_DIR = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use for themselves.
        T.StructField("size", T.StringType()),
        T.StructField("row", T.StringType()),
        T.StructField("fp", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("words", T.StringType()),
        T.StructField("slice", T.StringType()),
    ]
)


def rows_of(texts, lang="en", source="s"):
    out = []
    for i, text in enumerate(texts):
        out.append((i, text, lang, source, len(text) if text is not None else None, "x", "x", "x", "x", "x", "x"))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from texts, or from whole rows."""
    from geopulse.llm.queries import importable

    importable(spark)

    def make(texts, rows=None):
        return spark.createDataFrame(rows if rows is not None else rows_of(texts), DOCS)

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, short, repeated, very long, control characters and other scripts."""
    random.seed(3)
    words = ["alpha", "Beta", "gamma", "ДЕЛЬТА", "été", "日本", "x1", "the", "of", "#tag", "a|b"]
    long = " ".join(random.choice(words) for _ in range(30_000))
    prose = " ".join(random.choice(words) for _ in range(60))
    return [
        None, "", " \t\n\x0b\x0c\r ", "one", "a b c", "a b c", prose, prose + " more", long, "line\nline\nline\n\n",
        "\x1c\x85  ", "MIT License", "😀 é " * 40, "one one one one one one one one one one " * 9,
    ]


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("LLM_SF_DIR", SF_DIR)
