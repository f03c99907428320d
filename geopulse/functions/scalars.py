"""Scores, topics, rounding and dates as Column expressions."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from geopulse.constants import INVALID_SCORE, SCORE_LABELS
from geopulse.functions.lookup import let


def _col(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def round_half_even(col, digits=2) -> Column:
    """Rounding as numeric libraries do it: scale, round half to even, scale back."""
    scale = float(10**digits)
    return F.rint(_col(col) * scale) / scale


def score_bin(col) -> Column:
    """Nine-point score of a value in -1..1. The neutral bin 5 is open at both ends."""
    x = _col(col)
    return (
        F.when(x.isNull(), F.lit(None).cast("int"))
        .when(x <= -0.8, 1)
        .when(x <= -0.6, 2)
        .when(x <= -0.4, 3)
        .when(x <= -0.2, 4)
        .when(x < 0.2, 5)
        .when(x < 0.4, 6)
        .when(x < 0.6, 7)
        .when(x < 0.8, 8)
        .otherwise(9)
    )


def score_label(col) -> Column:
    score = _col(col)
    out = reduce(
        lambda acc, item: acc.when(score == item[0], item[1]), SCORE_LABELS.items(), F
    )
    return out.otherwise(INVALID_SCORE)


def _any_of(lowered, topic_words) -> Column:
    if topic_words is None:
        return F.lit(True)
    return reduce(lambda a, b: a | b, [F.contains(lowered, F.lit(w)) for w in topic_words])


def mentions(col, topic_words) -> Column:
    """Lower-cased text contains any of the words; ``None`` stands for every post."""
    if topic_words is None:
        return F.lit(True)
    return let(F.lower(_col(col)), lambda lowered: _any_of(lowered, topic_words))


def topic_flags(col, topics) -> Column:
    """Struct of one flag for each topic; the text is lower-cased once for all of them."""
    return let(
        F.lower(_col(col)),
        lambda lowered: F.struct(*[_any_of(lowered, words).alias(name) for name, words in topics.items()]),
    )


def topic_title(col, topic_words, name) -> Column:
    """``<Name>Mentioned`` or ``<Name>Absent``; NULL for a missing text."""
    titles = [F.lit(f"{name}Mentioned"), F.lit(f"{name}Absent")]
    return let(mentions(col, topic_words), lambda flag: F.when(flag, titles[0]).when(~flag, titles[1]))


def key_part(col, index=0) -> Column:
    return F.get(_col(col), F.lit(index))


def iso_utc(col) -> Column:
    """UTC timestamp text with milliseconds fixed at 000."""
    return F.date_format(_col(col), "yyyy-MM-dd'T'HH:mm:ss'.000Z'")


def local_ts(col, tz) -> Column:
    return F.from_utc_timestamp(_col(col), tz)


def local_date(col, tz) -> Column:
    return F.to_date(local_ts(col, tz))
