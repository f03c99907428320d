"""Joins against a dimension: broadcast when its size is checked, salted beyond that."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.session import checkpointed, scratch_of, written

MAX_BROADCAST_ROWS = 500_000
MAX_BROADCAST_BYTES = 64 << 20
HOT_FRACTION = 0.001


def fits(df: DataFrame, max_rows: int, max_bytes=MAX_BROADCAST_BYTES) -> bool:
    """Whether the frame has at most ``max_rows`` rows and about ``max_bytes``; never reads further."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, used = df.limit(max_rows + 1).agg(F.count("*"), size).first()
    return rows <= max_rows and (used or 0) <= max_bytes


class Dimension:
    """A table to join against: computed once, its size checked once.

    A small one is broadcast, a large one goes through :func:`salted_join`.
    """

    def __init__(self, frame: DataFrame, max_rows=MAX_BROADCAST_ROWS):
        self.frame = checkpointed(frame)
        self.small = fits(self.frame, max_rows)

    def joined(self, left: DataFrame, key, row_key, how="left", salts=64) -> DataFrame:
        """Join on one column; ``row_key`` names columns of ``left`` that identify a row."""
        if self.small:
            return left.join(F.broadcast(self.frame), key, how)
        return salted_join(left, self.frame, key, row_key, how, salts)


def lookup_join(left, right, key, row_key, how="left", max_rows=MAX_BROADCAST_ROWS, salts=64):
    """One join against a dimension; see :class:`Dimension` for several."""
    return Dimension(right, max_rows).joined(left, key, row_key, how, salts)


ROW = "_row"


def with_row_id(df: DataFrame) -> DataFrame:
    """The rows with a number of their own (``ROW``), written down once.

    Joins that take rows apart and put them together again go by this number and not by a key of
    the data, which may repeat. A frame that has it already stays as it is.
    """
    if ROW in df.columns:
        return df
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def stored_rows(df: DataFrame) -> DataFrame:
    """The rows with a number of their own as a table; one that is such a table stays as it is."""
    return with_row_id(df) if ROW not in df.columns or scratch_of(df) else written(df, "rows")


def hot_keys(df: DataFrame, key: str, fraction=HOT_FRACTION) -> DataFrame:
    """Keys that hold at least ``fraction`` of the rows: never more than ``1/fraction`` of them."""
    counts = checkpointed(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= F.lit(max(2.0, total * fraction))).select(key)


def salted_join(left, right, key, row_key, how="left", salts=64, fraction=HOT_FRACTION):
    """Shuffle join in which every hot key of ``left`` is spread over ``salts`` tasks.

    The salt comes from ``row_key``, not from row order, so a task that runs again after the
    loss of an executor salts its rows the same way. NULL keys match nothing and are salted too,
    because they would otherwise all meet in one task.
    """
    hot = F.broadcast(hot_keys(left, key, fraction).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in row_key]), F.lit(salts)).cast("int")
    salted_left = left.join(hot, key, "left").withColumn(
        "_salt",
        F.when(F.col("_hot") | F.col(key).isNull(), spread).otherwise(F.lit(0)),
    )
    every_salt = F.sequence(F.lit(0), F.lit(salts - 1))
    salted_right = (
        right.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.when(F.col("_hot"), every_salt).otherwise(F.array(F.lit(0)))))
        .drop("_hot")
        .withColumnRenamed(key, "_key")
        .withColumnRenamed("_salt", "_rsalt")
    )
    joined = salted_left.join(
        salted_right,
        (F.col(key) == F.col("_key")) & (F.col("_salt") == F.col("_rsalt")),
        how,
    )
    return joined.drop("_hot", "_salt", "_key", "_rsalt")
