"""Official tables: description, outlier removal, regrouping and comparison with posts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopulse.constants import FENCE_FACTOR, PERCENTILES
from geopulse.functions.scalars import round_half_even
from geopulse.session import checkpointed


def running_counts(histogram: DataFrame, group, order, n="n") -> DataFrame:
    """Adds ``upto``, the number of counted rows up to and including each value of its group.

    Also adds ``total`` and ``mean`` of the group. A prefix sum in two steps: values are
    range-partitioned, slice totals give what lies before a slice, and a window runs inside each
    slice. No task ever holds a whole group.
    """
    sliced = histogram.repartitionByRange(group, order).withColumn("_slice", F.spark_partition_id())
    # Range bounds come from sampling; the cut keeps both uses below on the same slices.
    sliced = checkpointed(sliced)
    totals = sliced.groupBy(group, "_slice").agg(
        F.sum(n).alias("_n"), F.sum(F.col(n) * F.col(order)).alias("_sum")
    )
    # One row per slice and group that meet. Group columns with many values make many, so the planner
    # chooses the join by the measured size.
    whole = Window.partitionBy(group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = totals.select(
        group,
        "_slice",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_n").over(whole).alias("total"),
        (F.sum("_sum").over(whole) / F.sum("_n").over(whole)).alias("mean"),
    )
    inside = F.sum(n).over(Window.partitionBy(group, "_slice").orderBy(order))
    return (
        sliced.join(slices, [group, "_slice"])
        .withColumn("upto", F.col("_before") + inside)
        .drop("_slice", "_before")
    )


def describe5(df: DataFrame, cols, digits=2) -> DataFrame:
    """Count, mean, sample deviation and five exact quantiles per column, as one row per column.

    Rows: ``(metric, count, mean, std, min, q0, q25, q50, q75, q100, max)``, rounded half to even.
    Equal values are counted first, so what is sorted is the distinct values.
    """
    numbers = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    long = numbers.unpivot([], list(cols), "metric", "z").where("z IS NOT NULL AND NOT isnan(z)")
    ranked = running_counts(long.groupBy("metric", "z").agg(F.count("*").alias("n")), "metric", "z")
    first = F.col("upto") - F.col("n")

    def order_statistic(rank):
        return F.max(F.when((first <= rank) & (rank < F.col("upto")), F.col("z")))

    aggs = [
        F.first("total").alias("count"),
        F.first("mean").alias("mean"),
        F.sum(F.col("n") * F.pow(F.col("z") - F.col("mean"), 2)).alias("_squares"),
        F.min("z").alias("min"),
        F.max("z").alias("max"),
    ]
    for p in PERCENTILES:
        at = (F.col("total") - 1) * F.lit(p)
        name = f"q{round(p * 100)}"
        aggs += [
            order_statistic(F.floor(at)).alias(f"{name}_lo"),
            order_statistic(F.ceil(at)).alias(f"{name}_hi"),
            F.first(at - F.floor(at)).alias(f"{name}_t"),
        ]
    wide = ranked.groupBy("metric").agg(*aggs)

    def quantile(name):
        lo, hi, t = (F.col(f"{name}_{part}") for part in ("lo", "hi", "t"))
        # Interpolate from the nearer end, as array libraries do.
        return F.when(t >= 0.5, hi - (hi - lo) * (1 - t)).otherwise(lo + (hi - lo) * t)

    deviation = F.when(F.col("count") > 1, F.sqrt(F.col("_squares") / (F.col("count") - 1)))
    names = [f"q{round(p * 100)}" for p in PERCENTILES]
    return wide.select(
        "metric",
        F.col("count").cast("bigint").alias("count"),
        round_half_even("mean", digits).alias("mean"),
        round_half_even(deviation, digits).alias("std"),
        round_half_even("min", digits).alias("min"),
        *[round_half_even(quantile(name), digits).alias(name) for name in names],
        round_half_even("max", digits).alias("max"),
    )


def fences(summary: DataFrame, factor=FENCE_FACTOR) -> DataFrame:
    """Lower and upper bound per metric, from the already rounded quartiles."""
    spread = F.col("q75") - F.col("q25")
    return summary.select(
        "metric",
        (F.col("q25") - F.lit(factor) * spread).alias("lower"),
        (F.col("q75") + F.lit(factor) * spread).alias("upper"),
    )


def drop_outliers(df: DataFrame, cols, summary=None) -> DataFrame:
    """Rows inside the fences of every column; a missing value counts as inside.

    The fences come from one description taken before any row is dropped. They are one row per
    column, and go into the filter as constants, so they reach the scan.
    """
    summary = describe5(df, cols) if summary is None else summary
    bounds = fences(summary).where(F.col("metric").isin(list(cols))).collect()
    inside = [
        F.coalesce(
            F.col(f"`{b.metric}`").between(b.lower, b.upper) | F.isnan(F.col(f"`{b.metric}`").cast("double")),
            F.lit(True),
        )
        for b in bounds
    ]
    return df.where(reduce(lambda a, b: a & b, inside, F.lit(True)))


def regroup(df: DataFrame, code, mean_cols=(), sum_cols=()) -> DataFrame:
    """Areas gathered below a coarser code."""
    return df.groupBy(code).agg(
        *[F.avg(c).alias(f"avg_{c}") for c in mean_cols],
        *[F.sum(c).alias(f"sum_{c}") for c in sum_cols],
        F.count("*").alias("areas"),
    )


def count_bands(view: DataFrame, count="count", edges=(1, 10, 100)) -> DataFrame:
    """How many regions fall in each band of post counts, and their share in percent."""
    lo, mid, hi = edges
    c = F.col(count)
    band = (
        F.when((c >= lo) & (c <= mid), f"{lo}-{mid}")
        .when((c > mid) & (c <= hi), f"{mid}-{hi}")
        .when(c > hi, f">{hi}")
    )
    counted = view.where(c >= lo).groupBy(band.alias("band")).agg(F.count("*").alias("regions"))
    # Three bands at most, so one window over all of them is small.
    share = F.col("regions") * 100.0 / F.sum("regions").over(Window.partitionBy())
    return counted.select("band", "regions", round_half_even(share).alias("share"))


def area_correlation(df: DataFrame, x, y) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return both.agg(F.corr(x, y).alias("correlation"), F.count("*").alias("areas"))


def correlations(df: DataFrame, xs, ys) -> DataFrame:
    """``x, y, correlation, areas`` of every column of ``xs`` with every one of ``ys``, from one aggregate.

    Each row becomes a row for each pair, and a task adds up a pair's co-moments before the shuffle. A pair
    counts the rows that have both values; without any its correlation is NULL.
    """
    wide = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(xs)], *[F.col(f"`{c}`").cast("double").alias(f"y{i}") for i, c in enumerate(ys)])
    # A row of NULLs, so that a table without rows has its pairs as well.
    wide = wide.unionByName(df.sparkSession.range(1).select(*[F.lit(None).cast("double").alias(c) for c in wide.columns]))
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col(f"x{i}").alias("x"), F.col(f"y{j}").alias("y")) for i in range(len(xs)) for j in range(len(ys))]
    found = wide.select(F.inline(F.array(*pairs))).groupBy("i", "j").agg(
        F.corr("x", "y").alias("correlation"), F.count(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), 1)).alias("areas")
    )
    names = [F.array(*[F.lit(c) for c in columns]) for columns in (xs, ys)]
    return found.select(F.get(names[0], F.col("i")).alias("x"), F.get(names[1], F.col("j")).alias("y"), "correlation", "areas")


def extremes(df: DataFrame, label, cols) -> DataFrame:
    """Region with the largest and the smallest value of each metric; ties go to the first label."""

    def struct(value):
        return F.struct(value.alias("v"), F.col(label).alias("l"))

    per_metric = []
    for c in cols:
        z = F.col(c)
        per_metric.append(F.min(F.when(z.isNotNull(), struct(-z))).alias(f"{c}_top"))
        per_metric.append(F.min(F.when(z.isNotNull(), struct(z))).alias(f"{c}_low"))
    ends = df.agg(*per_metric)
    rows = [
        F.struct(
            F.lit(c).alias("metric"),
            F.col(f"{c}_top")["l"].alias("highest"),
            (-F.col(f"{c}_top")["v"]).alias("highest_value"),
            F.col(f"{c}_low")["l"].alias("lowest"),
            F.col(f"{c}_low")["v"].alias("lowest_value"),
        )
        for c in cols
    ]
    return ends.select(F.inline(F.array(*rows)))


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    loaded = before.agg(F.count("*").alias("rows")).select(F.lit("loaded").alias("stage"), "rows")
    remaining = after.agg(F.count("*").alias("rows")).select(F.lit("remaining").alias("stage"), "rows")
    return loaded.unionAll(remaining)


def compare_scenario(posts_by_area: DataFrame, official: DataFrame, key, x, y) -> DataFrame:
    """Correlation of a post metric and an official metric over the areas both tables know."""
    return area_correlation(posts_by_area.join(official, key), x, y)
