import math
import random

import pytest
from pyspark.sql import functions as F

from geopulse.functions.lookup import Lookup
from geopulse.operators import language, sentiment


def frames_equal(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(3)
    words = ["good", "bad", "very", "not", "plain", "Cats", "isn't", "!", "barely", "ok"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(300)]
    rows += [(1000 + i, "good good bad") for i in range(150)] + [(5000, ""), (5001, None), (5002, "  ")]
    return spark.createDataFrame(rows, "id int, text string")


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 19), ("bad", -25), ("ok", 9)], "token string, valence int")


@pytest.fixture(scope="module")
def lemmas(spark):
    return spark.createDataFrame([("Cats", "cat"), ("is", "be")], "token string, lemma string")


def test_lookup(spark):
    dim = spark.createDataFrame([("a", 1), ("é\"\\", 2), ("", 3)], "k string, v int")
    table = Lookup.from_frame(dim, "k", "v")
    keys = spark.createDataFrame([("a",), ("é\"\\",), ("",), ("x",), (None,)], "k string")
    assert [r.v for r in keys.select(table.get(F.col("k")).alias("v")).collect()] == [1, 2, 3, None, None]
    assert Lookup.from_frame(dim, "k", "v", max_rows=2) is None
    empty = Lookup.from_frame(dim.limit(0), "k", "v")
    assert keys.select(empty.get(F.col("k")).alias("v")).first().v is None


def test_normalised_text_by_lookup_and_join(spark, posts, lemmas):
    small = sentiment.normalise_text(posts, "text", lemmas, ["id"])
    large = sentiment.normalise_text(posts, "text", lemmas, ["id"], max_rows=0)
    assert frames_equal(small.select("id", "content"), large.select("id", "content"))
    got = {r.id: r.content for r in small.where("id >= 5000").collect()}
    assert got == {5000: "", 5001: None, 5002: ""}


def python_compound(text, valence, rules):
    tokens = text.lower().split(" ")
    total = 0.0
    for i, token in enumerate(tokens):
        if token not in valence:
            continue
        v = valence[token] / 10
        sign = 1 if v > 0 else -1
        ahead = [tokens[i - k] if i >= k else None for k in (1, 2, 3)]
        if rules:
            for word, strength in zip(ahead, (0.293, 0.27835, 0.2637)):
                if word not in valence:
                    v += sentiment.BOOSTERS.get(word, 0) * sign * strength
            for word in ahead:
                if word in sentiment.NEGATORS and word not in valence:
                    v *= -0.74
        total += v
    return total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("rules", [False, True])
@pytest.mark.parametrize("max_rows", [1000, 0], ids=["lookup", "join"])
def test_polarity(spark, posts, lexicon, rules, max_rows):
    scored = sentiment.polarity(posts, "text", lexicon, ["id"], rules=rules, max_rows=max_rows)
    valence = {r.token: r.valence for r in lexicon.collect()}
    rows = scored.collect()
    assert len(rows) == posts.count()
    for r in rows:
        if r.text is None:
            assert r.compound is None
        else:
            assert r.compound == pytest.approx(python_compound(r.text, valence, rules), abs=1e-7)


def test_histogram_is_zero_filled_and_adds_up(spark, posts):
    scored = posts.select((F.col("id") % 4 + 1).alias("score"))
    got = {r.score: r["count"] for r in sentiment.score_histogram(scored).collect()}
    assert sorted(got) == list(range(1, 10)) and sum(got.values()) == posts.count() and got[9] == 0
    view = scored.groupBy("score").agg(F.count("*").alias("n")).unionAll(spark.createDataFrame([(1, 5)], "score int, n bigint"))
    assert {r.score: r["count"] for r in sentiment.score_histogram(view, count="n").collect()}[1] == got[1] + 5


def test_language(spark):
    train = spark.createDataFrame(
        [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr")],
        "text string, lang string",
    )
    profiles = language.train_lang(train, "text", "lang")
    rows = [(i, t) for i, t in enumerate(["the dog", "die katze!", "LE CHIEN", "123 777", "", None, "x the_cat é"])]
    rows += [(100 + i, "und die " * (i + 1)) for i in range(50)]
    texts = spark.createDataFrame(rows, "id int, text string")
    small = language.detect_lang(texts, "text", profiles, ["id"])
    large = language.detect_lang(texts, "text", profiles, ["id"], max_rows=0)
    assert frames_equal(small.select("id", "lang"), large.select("id", "lang"))
    got = {r.id: r.lang for r in small.collect()}
    assert [got[i] for i in range(6)] == ["en", "de", "fr", None, None, None]


def test_profiles_are_ranked(spark):
    train = spark.createDataFrame([("aa aa b", "x")], "text string, lang string")
    got = {r.gram: r.weight for r in language.train_lang(train, "text", "lang", size=3).collect()}
    assert got == {"_aa": 3, "aa_": 2, "_b_": 1}
