import pytest
from pyspark.sql import functions as F

from geopulse.functions import scalars, text


def one(spark, col, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col.alias("x"))
    return row.first().x


@pytest.mark.parametrize(
    "raw, want",
    [
        ("@anné  hi", "hi"),
        ("a #tag b", "a b"),
        ("see https://x.y/z?q=1 now", "see  now"),
        ("http://a", ""),
        ("me@home # x", "me# x"),
        ("plain", "plain"),
    ],
)
def test_strip_social(spark, raw, want):
    assert one(spark, text.strip_social("t"), t=raw) == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("melbourne, victoria", "melbourne vic"),
        ("victoria park - perth", "vic park perth"),
        ("st. kilda (vic.)", "st kilda vic"),
        ("new south wales, australia", "nsw australia"),
        (" a ", " a "),
    ],
)
def test_normalise_location(spark, raw, want):
    assert one(spark, text.normalise_location("t"), t=raw) == want


def test_word_subsequences_follow_size_then_position(spark):
    from itertools import combinations

    words = "a b c b".split()
    want = [" ".join(c) for n in range(1, 5) for c in combinations(words, n)]
    assert one(spark, text.word_subsequences("t"), t="a b c b") == want


def test_word_subsequences_refuse_long_input(spark):
    with pytest.raises(Exception, match="more than 3 words"):
        one(spark, text.word_subsequences("t", max_words=3), t="a b c d")


@pytest.mark.parametrize("name, want", [("a b", None), ("a b c", ["a b", "b c"]), ("a", None)])
def test_bigrams_need_three_words(spark, name, want):
    assert one(spark, text.name_bigrams("t"), t=name) == want


def test_place_name(spark):
    assert one(spark, text.place_name("t"), t="St. Ives (N.S.W.) - West") == "St Ives NSW West"


@pytest.mark.parametrize(
    "page, want",
    [
        ("<p>Good &amp; fair</p><p>work</p>", "Good & fairwork"),
        ("a<script>if (1<2) x()</script>b<style>p{}</style>c<!-- d -->e", "abce"),
        ("&#233;&#x1F600;&lt;b&gt; AT&T &unknown; &amp;lt;", "é😀<b> AT&T &unknown; &lt;"),
        ("1 < 2 and <b>3</b>", "1 < 2 and 3"),
        # An old name counts without a semicolon too, as the beginning of a longer word.
        ("cut &amp</p><p>Off &ampOff &notit; &notin;", "cut &Off &Off ¬it; ∉"),
        ("x&#0000000065;y &#x00000041;z", "xAy Az"),
        ("a &#9999999; &#0; &#xD800; &#128; &#x9F; b", "a \ufffd \ufffd \ufffd € Ÿ b"),
        ("", ""),
    ],
)
def test_html_to_text(spark, page, want):
    assert one(spark, text.html_to_text("t"), t=page) == want


def test_tokenise(spark):
    got = one(spark, text.tokenise("t"), t="Don't stop, it's O'Neil's 3.5é!")
    assert got == ["Do", "n't", "stop", ",", "it", "'s", "O", "'", "Neil", "'s", "3", ".", "5é", "!"]


@pytest.mark.parametrize(
    "x, want",
    [
        (-1.0, 1), (-0.8, 1), (-0.79, 2), (-0.6, 2), (-0.4, 3), (-0.2, 4), (-0.19, 5), (0.0, 5),
        (0.19, 5), (0.2, 6), (0.4, 7), (0.6, 8), (0.79, 8), (0.8, 9), (1.0, 9), (float("nan"), 9),
    ],
)
def test_score_bin_borders(spark, x, want):
    assert one(spark, scalars.score_bin("x"), x=x) == want


def test_score_of_nothing_is_nothing(spark):
    assert one(spark, scalars.score_bin(F.lit(None).cast("double"))) is None


@pytest.mark.parametrize("s, want", [(1, "Extremely Negative"), (5, "Neutral"), (9, "Extremely Positive"), (0, "Invalid score"), (10, "Invalid score")])
def test_score_label(spark, s, want):
    assert one(spark, scalars.score_label("s"), s=s) == want


@pytest.mark.parametrize("x", [0.125, 0.135, 2.675, 1.005, -0.125, 1e6 + 0.005])
def test_round_like_numpy(spark, x):
    import numpy as np

    assert one(spark, scalars.round_half_even("x"), x=x) == np.round(x, 2)


def test_topics_match_inside_words(spark):
    from geopulse.constants import TOPICS

    assert one(spark, scalars.mentions("t", TOPICS["income"]), t="My NETWORK") is True
    assert one(spark, scalars.mentions("t", TOPICS["crime"]), t="criminals") is True
    assert one(spark, scalars.topic_title("t", TOPICS["crime"], "Crime"), t="quiet") == "CrimeAbsent"
    null = F.lit(None).cast("string")
    assert one(spark, scalars.topic_title(null, TOPICS["crime"], "Crime")) is None


def test_dates(spark):
    ts = F.lit("2023-05-01 20:30:15.123").cast("timestamp")
    assert one(spark, scalars.iso_utc(ts)) == "2023-05-01T20:30:15.000Z"
    assert str(one(spark, scalars.local_date(ts, "Australia/Melbourne"))) == "2023-05-02"


def test_marks_are_stripped_in_order(spark):
    # What is left of one mark may make another.
    got = [one(spark, text.strip_social("t"), t=t) for t in ("a @b c #d e http://f g", "#@a b", "ht@x tp://y z", "no mark", None)]
    assert got == ["a c e  g", "", " z", "no mark", None]


def test_plain_words_are_the_words(spark):
    for t in ("Ab,c  d_1 é\n--x", " .", "", "a"):
        plain = one(spark, text.plain_words("t"), t=t)
        assert [w for w in plain.split(" ") if w] == one(spark, text.words("t"), t=t)
