"""A corpus from raw documents to tokens: five stages, each on all that the one before kept.

Each stage is a function ``(spark, docs, sf_dir) -> DataFrame``; its result is written and read again as the
next one's ``docs``. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from geopulse.llm import block_mix, byte_bpe, lang_conv, line_dedup, near_copies
from geopulse.llm.common import table, written
from geopulse.llm.queries import importable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the network tells; trained on the labelled ones among them."""
    importable(spark)
    return lang_conv.identified(docs, lang_conv.train(docs))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are similar to an earlier one."""
    return line_dedup.without_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, Jaccard similarity 0.8 or more."""
    importable(spark)
    return near_copies.one_of_each(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that a mix of sources by weight takes, once for each time it takes them."""
    return block_mix.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of each document as counts and digests, with the digest of what they decode to."""
    importable(spark)
    return byte_bpe.round_trip(docs, *byte_bpe.vocabulary()).drop("whole")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("source_mix", source_mix),
    ("byte_bpe", tokens),
]

# A trained network, hashes of 64 bits and a BPE library have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
