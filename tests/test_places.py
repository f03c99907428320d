import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from geopulse.operators import gazetteer as gz


def brute(place, sal_of):
    words = place.split(" ")
    for n in range(1, len(words) + 1):
        for chosen in combinations(words, n):
            if sal_of.get(" ".join(chosen)):
                return sal_of[" ".join(chosen)]
    return None


def gazetteer_frame(spark, sal_of):
    return spark.createDataFrame(list(sal_of.items()), "location string, sal string")


@pytest.mark.parametrize("max_rows", [100_000, 0], ids=["lookup", "join"])
def test_resolution_equals_brute_force(spark, max_rows):
    rng = random.Random(7)
    vocabulary = list("abcdefg") + ["north", "west"]
    names = {" ".join(rng.choices(vocabulary, k=rng.randint(1, 4))) for _ in range(150)}
    sal_of = {n: rng.choice([None, "", str(i), str(i), str(i)]) for i, n in enumerate(sorted(names))}
    # Half of the words stand at the head of many names, one place string holds a third of the rows.
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 6))) for _ in range(400)]
    texts += ["north a west"] * 200 + ["", " a", "a ", "unknown"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(len(texts), None)]
    posts = spark.createDataFrame(rows, "id int, place string")
    found = gz.resolve_location(posts, gazetteer_frame(spark, sal_of), "place", ["id"], max_rows=max_rows)
    got = {r.id: r.sal for r in found.collect()}
    assert len(got) == len(rows)
    assert got == {i: brute(t, sal_of) if t is not None else None for i, t in rows}


def test_match_is_returned(spark):
    posts = spark.createDataFrame([(1, "old park x west"), (2, "none")], "id int, place string")
    gazetteer = gazetteer_frame(spark, {"park west": "7", "old": ""})
    got = gz.resolve_location(posts, gazetteer, "place", ["id"], keep_match=True).orderBy("id").collect()
    assert got[0].possible_suburb["park west"].sal == "7"
    assert got[1].possible_suburb == {}


def test_gazetteer_pairs_override_names(spark):
    rows = [
        (1, "middle park (vic.)", "g", "21640"), (2, "north west - hill", "g", "21999"),
        (3, "north west", "g", "10001"), (4, "twin", "g", "1"), (5, "twin", "g", "2"), (6, "lost two words", "g", None),
    ]
    places = spark.createDataFrame(rows, "ord int, location string, gcc string, sal string")
    got = {r.location: (r.sal, r.real_loc) for r in gz.build_gazetteer(places).collect()}
    assert got["north west"] == ("21999", "north west hill")
    assert got["middle park"] == ("21640", "middle park vic")
    assert got["twin"] == ("2", "twin")
    assert "lost two" not in got and got["lost two words"][0] is None


def test_common_words_do_not_anchor(spark):
    sal_of = {f"north {i}": str(i) for i in range(20)}
    anchors = gz._anchored(gazetteer_frame(spark, sal_of)).where(F.col("anchor") == "north").count()
    assert anchors == 0
