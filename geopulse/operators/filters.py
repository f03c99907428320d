"""Row filters and column tidying shared by the jobs."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.constants import INVALID_PLACES, MIN_ID_LENGTH


def valid_id(df: DataFrame, min_len=MIN_ID_LENGTH, col="tid") -> DataFrame:
    return df.where(F.length(col) >= min_len)


def require(df: DataFrame, cols, allow_empty=False) -> DataFrame:
    """Keep rows in which every column is present, and non-empty unless ``allow_empty``."""
    tests = [F.col(c).isNotNull() if allow_empty else F.col(c) != "" for c in cols]
    return df.where(reduce(lambda a, b: a & b, tests))


def geo_only(df: DataFrame, location="location", sal=None) -> DataFrame:
    """Keep rows with a place string and, once resolved, a region code."""
    out = df.where(F.col(location).isNotNull())
    return require(out, [sal]) if sal else out


def without_invalid_places(df: DataFrame, place="place") -> DataFrame:
    """Drop normalised places that name a whole state or country. Optional; no job applies it."""
    return df.where(F.col(place).isNull() | ~F.col(place).isin(INVALID_PLACES))


def in_state(df: DataFrame, state, col) -> DataFrame:
    return df.where(F.col(col) == state)


def contains(df: DataFrame, col, needle) -> DataFrame:
    return df.where(F.contains(F.col(col), F.lit(needle)))


def drop_any_null(df: DataFrame, cols=None) -> DataFrame:
    return df.na.drop("any", subset=cols)


def drop_all_null(df: DataFrame, cols) -> DataFrame:
    return df.na.drop("all", subset=cols)


def fill_zero(df: DataFrame, cols) -> DataFrame:
    """Zero for missing numbers; text columns are left alone."""
    return df.na.fill(0, subset=cols)


def row_sum(df: DataFrame, cols, out) -> DataFrame:
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])
    return df.withColumn(out, total)


def ready_for_join(view: DataFrame, topic, code) -> DataFrame:
    """View rows as a metric frame: text region code, count and average score of the topic."""
    from geopulse.operators.views import average_sentiment

    return view.select(
        F.col("key")[0].cast("string").alias(code),
        F.col("count").alias(f"count {topic}"),
        average_sentiment("sum", "count").alias(f"average_sentiment({topic})"),
    )
