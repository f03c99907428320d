"""Lemmas by rule and the whole compound score against plain loops."""

import math
import random
import re

import pytest

from geopulse.operators import sentiment
from geopulse.operators.lemmas import NOUN_RULES, RuleLemmatiser

WORDS = ["glass", "class", "wolf", "box", "buzz", "church", "wish", "man", "woman", "women", "city", "bus", "cat", "dog", "s", "as", "gas", "ox", "lens", "Cats"]
EXCEPTIONS = [("oxen", "ox"), ("lice", "louse"), ("buses", "bus"), ("axes", "ax"), ("axes", "axis"), ("dogs", "dog"), ("women", "woman")]


def plain_lemma(token, words, exceptions):
    if token in exceptions:
        levels = [[token, *exceptions[token]]]
    else:
        levels, forms = [], [token]
        while forms:
            made = [f[: len(f) - len(old)] + new for f in forms for old, new in NOUN_RULES if f.endswith(old)]
            levels.append(([token] if not levels else []) + made)
            forms = made
    for level in levels:
        known = [f for f in level if f in words]
        if known:
            return min(known, key=lambda f: (len(f), f != token, f))
    return token


TOKENS = [
    "glasses", "classes", "wolves", "boxes", "buzzes", "churches", "wishes", "men", "women", "cities", "buses", "cats", "dogs", "gases",
    "oxen", "lice", "axes", "ss", "sss", "asses", "lenses", "Cats", "cat", "unknowns", "ies", "s", "xes", "menmen", "dogsss", "é", "boxses",
]


@pytest.mark.parametrize("max_rows", [100_000, 0])
def test_lemmas_by_rule(spark, max_rows):
    exceptions = {}
    for token, lemma in EXCEPTIONS:
        exceptions.setdefault(token, []).append(lemma)
    dictionary = spark.createDataFrame([(w,) for w in [*WORDS, "cat", None, "ax"]], "word string")
    model = RuleLemmatiser(dictionary, spark.createDataFrame([*EXCEPTIONS, EXCEPTIONS[0], (None, "x")], "token string, lemma string"), max_rows=max_rows)
    assert model.joins == (max_rows == 0)
    random.seed(1)
    texts = [" ".join(random.choice(TOKENS) for _ in range(random.randint(1, 12))) for _ in range(60)] + [None, "", " "] + TOKENS
    df = spark.createDataFrame([(i % 7, t) for i, t in enumerate(texts)], "id int, text string")
    got = [r.content for r in model.normalise(df, "text", ["id"]).select("text", "content").collect()]
    words = set(WORDS) | {"ax"}
    want = [None if t is None else " ".join(plain_lemma(w, words, exceptions) for w in t.split()) for t in texts]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert plain_lemma("glasses", words, exceptions) == "glass" and plain_lemma("axes", words, exceptions) == "ax"


def test_lemmas_without_exceptions_plug_into_a_job(spark):
    from geopulse.plans.jobs import Enrichers, enrich

    model = RuleLemmatiser(spark.createDataFrame([("cat",)], "word string"))
    lexicon = spark.createDataFrame([("cat", 20)], "token string, valence int")
    scorer = sentiment.FullScorer(lexicon)
    steps = Enrichers(model.normalise, lambda df, text, key, out: df.withColumn(out, df[text]), scorer.score)
    row = enrich(spark.createDataFrame([("1", "two cats")], "tid string, text string"), steps).first()
    assert row.content == "two cat" and row.score > 5


# --- compound score --------------------------------------------------------------------------------

LEXICON = {"good": 19, "bad": -25, "fine": 8, "kiss": 18, "death": -29, "no": -12, "ok": 9}
PHRASES = {"kiss of death": -15, "kiss of": 4, "of death by": 7, "bad good": 20, "very fine": 30}


def plain_compound(text, lexicon, phrases):
    words = []
    for w in re.split(r"[ \t\n\x0b\f\r]+", text):
        bare = w.strip(sentiment.PUNCTUATION)
        words += [bare if len(bare) > 2 else w] if w else []
    low = [w.lower() for w in words]
    capital = [w.upper() == w and w.lower() != w for w in words]
    mixed = 0 < sum(capital) < len(words)
    length = [max([n for n in (1, 2, 3) if " ".join(low[i : i + n]) in phrases and i + n <= len(low)], default=0) for i in range(len(low))]
    inside = [any(length[i - k] > k for k in (1, 2) if i >= k) for i in range(len(low))]
    valence = [None if inside[i] else phrases[" ".join(low[i : i + length[i]])] if length[i] else lexicon.get(low[i]) for i in range(len(low))]
    rules = {**sentiment.BOOSTERS, **dict.fromkeys(sentiment.NEGATORS, 2)}
    rule = [rules.get(low[i]) if not inside[i] and not length[i] and low[i] not in lexicon else None for i in range(len(low))]
    contrast = low.index("but") if "but" in low else None
    total = 0
    for i, v in enumerate(valence):
        if v is None:
            continue
        sign = (v > 0) - (v < 0)
        value = v / 10 + (sign * 0.733 if mixed and capital[i] else 0)
        for k, fade in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= k and rule[i - k] in (1, -1):
                value += sign * fade * (0.293 * rule[i - k] + (0.733 if mixed and capital[i - k] else 0))
        for k in (1, 2, 3):
            if i >= k and rule[i - k] == 2:
                value *= -0.74
        total += value * (1 if contrast is None or i == contrast else 0.5 if i < contrast else 1.5)
    asked = text.count("?")
    emphasis = min(text.count("!"), 4) * 0.292 + (0 if asked < 2 else asked * 0.18 if asked <= 3 else 0.96)
    total += ((total > 0) - (total < 0)) * emphasis
    return total / math.sqrt(total * total + 15)


@pytest.mark.parametrize("max_rows", [100_000, 0])
@pytest.mark.parametrize("with_phrases", [True, False])
def test_full_score_equals_plain_loop(spark, max_rows, with_phrases):
    random.seed(9)
    parts = ["good", "bad", "GOOD", "Bad!", "fine,", "very", "VERY", "not", "n't", "but", "BUT", "kiss", "of", "death", "by", "no", "so", "ok", ":)", "(good)", "plain", "barely", "Of", "é", "!!", "??"]
    texts = ["".join(random.choice(parts) + random.choice([" ", " ", "\n", " \t"]) for _ in range(random.randint(1, 14))) for _ in range(250)]
    texts += ["GOOD DAY", "kiss of death", "a kiss of death by bad good", "", "   ", "but", "good but bad", "bad?????", "good!!!!!!"]
    lexicon = spark.createDataFrame(list(LEXICON.items()), "token string, valence int")
    phrases = spark.createDataFrame([*PHRASES.items(), ("kiss of", 9), (None, 1)], "phrase string, valence int") if with_phrases else None
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(10_000, None)], "id int, text string")
    got = {r.id: r.compound for r in sentiment.FullScorer(lexicon, phrases, max_rows).score(df, "text", ["id"]).collect()}
    assert got.pop(10_000) is None
    for i, t in enumerate(texts):
        assert abs(got[i] - plain_compound(t, LEXICON, PHRASES if with_phrases else {})) < 1e-6, t


def test_too_many_phrases_are_refused(spark):
    phrases = spark.createDataFrame([(f"a b{i}", 1) for i in range(30)], "phrase string, valence int")
    with pytest.raises(ValueError):
        sentiment.Phrases(phrases, max_rows=10)
