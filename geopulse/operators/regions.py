"""Region tables: joining metrics, and one row per region and metric for maps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def region_metrics(regions: DataFrame, metrics: dict[str, DataFrame], code) -> DataFrame:
    """Left joins of metric frames onto regions by text code; regions without posts keep NULLs.

    The frames hold one row per region. No hint is given: the planner broadcasts them by their
    measured size and shuffles them otherwise.
    """
    out = regions.withColumn(code, F.col(code).cast("string"))
    for frame in metrics.values():
        out = out.join(frame.withColumn(code, F.col(code).cast("string")), code, "left")
    return out


def join_regions(official: DataFrame, regions: DataFrame, code, region_code=None) -> DataFrame:
    """Inner join of an official table to region boundaries by integer code."""
    region_code = region_code or code
    left = regions.withColumn("_code", F.expr(f"try_cast(`{region_code}` AS INT)")).drop(region_code)
    right = official.withColumn("_code", F.expr(f"try_cast(`{code}` AS INT)")).drop(code)
    return left.join(right, "_code").withColumnRenamed("_code", region_code)


def metric_layers(df: DataFrame, id_cols, cols) -> DataFrame:
    """Rows ``(ids, metric, z, zmin, zmax)``: one layer per metric column with its scale ends."""
    long = df.unpivot(list(id_cols), list(cols), "metric", "z")
    # One row per metric column, so this side of the join has a known bound.
    return long.join(F.broadcast(metric_range(df, cols)), "metric").select(
        *id_cols, "metric", "z", "zmin", "zmax"
    )


def metric_range(df: DataFrame, cols) -> DataFrame:
    """Smallest and largest value of each metric, from one aggregation over the wide rows."""
    ends = df.agg(
        *[F.struct(F.min(f"`{c}`").alias("lo"), F.max(f"`{c}`").alias("hi")).alias(c) for c in cols]
    )
    long = ends.unpivot([], list(cols), "metric", "ends")
    return long.select("metric", F.col("ends.lo").alias("zmin"), F.col("ends.hi").alias("zmax"))
