"""Pages and id ranges over posts ordered by id."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopulse.constants import PAGE_SIZE
from geopulse.functions.scalars import local_date
from geopulse.operators.docstore import high_water_mark


def page_after(df: DataFrame, cursor, n=PAGE_SIZE, by="tid") -> DataFrame:
    """Up to ``n`` rows above the cursor, nearest first."""
    return df.where(F.col(by) > cursor).orderBy(by).limit(n)


def page_before(df: DataFrame, cursor, n=1, by="tid") -> DataFrame:
    """Up to ``n`` rows below the cursor, newest first."""
    return df.where(F.col(by) < cursor).orderBy(F.desc(by)).limit(n)


def next_pages(source: DataFrame, stored: DataFrame, n=PAGE_SIZE, by="tid", server="server") -> DataFrame:
    """The next page of every server: up to ``n`` rows above what is stored of it, nearest first.

    A server with nothing new gives no rows. Each task keeps its own ``n`` candidates per server
    before the shuffle, so a server that holds most of the rows costs no more than the others.
    """
    marks = high_water_mark(stored, by, server).withColumnRenamed(by, "_mark")
    newer = source.join(marks, server, "left").where(F.col("_mark").isNull() | (F.col(by) > F.col("_mark")))
    rank = F.row_number().over(Window.partitionBy(server).orderBy(by))
    return newer.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_mark", "_rank")


def id_range_for_dates(df: DataFrame, since, until, tz, by="tid", ts="ts") -> DataFrame:
    """Smallest and largest id whose local date lies in ``since..until``.

    The filter on the raw timestamp (a day wider on both sides) reaches the scan; the exact test
    on the local date comes after it.
    """
    start, end = F.lit(since).cast("date"), F.lit(until).cast("date")
    coarse = (F.col(ts) >= F.date_sub(start, 1).cast("timestamp")) & (
        F.col(ts) < F.date_add(end, 2).cast("timestamp")
    )
    exact = local_date(ts, tz).between(start, end)
    return df.where(coarse & exact).agg(
        F.min(by).alias("min_id"), F.max(by).alias("max_id"), F.count("*").alias("posts")
    )
