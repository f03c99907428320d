"""Shared pieces of the operators.

Every operator reads its own key and text columns, renames them at once, and ignores all other
columns, so extra columns with clashing names cannot meet its outputs. A null text counts as empty
unless the operator says otherwise; a null key is a key like any other; repeated rows stay repeated.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.session import free, written  # noqa: F401

# White space of the word patterns, and a word: anything else.
SPACE = "\x20\x09-\x0d"
SPACE_CHARS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keyed_text(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Only the key and the text; a null text as empty."""
    return df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def words(text) -> Column:
    """The words of a text as an array (empty for no word)."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.filter(F.split(trimmed, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def lower_ascii(text) -> Column:
    """A-Z to a-z; other letters as they are."""
    return F.translate(text, UPPER, UPPER.lower())


def let(value, body) -> Column:
    """``body`` over a value that is computed once, as an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def doc_fold(key, folds: int) -> Column:
    """crc32 of the key as text, modulo ``folds``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
