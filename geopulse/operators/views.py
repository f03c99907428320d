"""Grouped views over posts: statistics of the score below composite keys."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.constants import CRIME_WORDS_V1, TOPICS
from geopulse.functions.scalars import mentions, round_half_even, topic_flags, topic_title


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def stats(value, when=None) -> dict[str, Column]:
    """The five statistics of a value, optionally over the rows where ``when`` holds."""
    x = _col(value)
    if when is not None:
        x = F.when(when, x)
    return {
        "sum": F.sum(x),
        "count": F.count(x) if when is None else F.count(F.when(when, F.lit(1))),
        "min": F.min(x),
        "max": F.max(x),
        "sumsqr": F.sum(x * x),
    }


REDUCERS = {
    "stats": stats,
    "sum": lambda value: {"sum": F.sum(_col(value))},
    "count": lambda value: {"count": F.count("*")},
}


def reduce_with(reducer, value) -> list[Column]:
    return [agg.alias(name) for name, agg in REDUCERS[reducer](value).items()]


def average_sentiment(total="sum", count="count") -> Column:
    return round_half_even(_col(total) / _col(count))


def view(df, key_cols, value="score", level=None, reducer="stats", ordered=False) -> DataFrame:
    """Rows grouped by the first ``level`` key columns; level 0 is one grand total.

    ``reducer=None`` gives the raw key and value rows. ``ordered`` sorts by key, as views are
    served; leave it off inside a job.
    """
    keys = list(key_cols) if level is None else list(key_cols)[:level]
    if reducer is None:
        out = df.select(*keys, F.col(value))
    else:
        out = df.groupBy(*keys).agg(*reduce_with(reducer, value))
    return out.orderBy(*keys) if ordered and keys else out


def view_levels(df, key_cols, value="score", reducer="stats") -> DataFrame:
    """All group levels of :func:`view` at once, told apart by ``level``.

    A missing region is a key of its own, so the level comes from the grouping id and never from
    a NULL in a key column.
    """
    n = len(key_cols)
    rolled = df.rollup(*key_cols).agg(F.grouping_id().alias("_gid"), *reduce_with(reducer, value))
    # A rollup sets the low bits of the grouping id: level k leaves the last n-k columns out.
    level = F.lit(n) - F.bit_count("_gid")
    return rolled.select(level.cast("int").alias("level"), *[c for c in rolled.columns if c != "_gid"])


def topic_view(posts, topic, key_cols=("sal",), level=None, text="content", value="score", words=None):
    """View over the posts of one topic. ``words`` overrides the topic's word list."""
    topic_words = TOPICS[topic] if words is None else words
    return view(posts.where(mentions(text, topic_words)), key_cols, value, level)


def topic_views(posts, topics=None, by="sal", text="content", value="score") -> DataFrame:
    """Count and average score of every topic per region, in one scan and one shuffle."""
    topics = topics or TOPICS
    flagged = posts.select(by, _col(value).alias("_value"), topic_flags(text, topics).alias("_topics"))
    aggs = []
    for name in topics:
        s = stats("_value", F.col("_topics")[name])
        # No post of the topic: NULL, as after a left join with a view that lacks the region.
        count = F.nullif(s["count"], F.lit(0))
        aggs += [
            count.alias(f"count {name}"),
            average_sentiment(s["sum"], count).alias(f"average_sentiment({name})"),
        ]
    return flagged.groupBy(by).agg(*aggs)


# The split by presence has an older list for crime.
SPLIT_TOPICS = {**TOPICS, "crime": CRIME_WORDS_V1}


def topic_split(posts, topic, by=("sal",), text="content", value="score", words=None) -> DataFrame:
    """Statistics of posts that mention the topic and of those that do not."""
    topic_words = SPLIT_TOPICS[topic] if words is None else words
    present = posts.where(_col(text).isNotNull())
    return view(present.withColumn("title", topic_title(text, topic_words, topic.capitalize())), ["title", *by], value)


def hierarchy(df, cols, value=None) -> DataFrame:
    """Parent-child rows ``(id, label, parent, value)``; every parent is the sum of its children.

    The id is the path from the root level joined with slashes; roots have an empty parent.
    """
    total = F.sum(value) if value else F.count("*")
    rolled = df.rollup(*cols).agg(F.grouping_id().alias("_gid"), total.alias("value"))
    rolled = rolled.withColumn("depth", (F.lit(len(cols)) - F.bit_count("_gid")).cast("int"))
    # A NULL label is a real group, so it is spelled out instead of being skipped.
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in cols]

    def at_depth(build):
        return reduce(
            lambda acc, d: acc.when(F.col("depth") == d, build(d)), range(1, len(cols) + 1), F
        )

    path = at_depth(lambda d: F.concat_ws("/", *parts[:d]))
    parent = at_depth(lambda d: F.concat_ws("/", *parts[: d - 1]))
    label = at_depth(lambda d: parts[d - 1])
    return rolled.where("depth > 0").select(
        path.alias("id"), label.alias("label"), parent.alias("parent"), "value", "depth"
    )


def map_view(df, emit, reducer=None, level=None) -> DataFrame:
    """User-defined view. ``emit`` turns documents into rows ``(key ARRAY<STRING>, value)``."""
    emitted = emit(df).select("key", "value")
    if reducer is None:
        return emitted
    key = F.col("key") if level is None else F.slice("key", 1, level) if level else F.array().cast("array<string>")
    return emitted.groupBy(key.alias("key")).agg(*reduce_with(reducer, "value"))
