import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geopulse.operators import docstore, filters, official, paging, regions, views
from geopulse.plans import skew


def test_describe_equals_pandas(spark):
    rng = np.random.default_rng(1)
    frame = pd.DataFrame(
        {"a": np.round(rng.gamma(2, 30, 1500), 2), "b": rng.integers(0, 5, 1500).astype(float), "c": [7.0] * 1500}
    )
    frame.loc[::3, "c"] = -1e12
    frame.loc[::7, "a"] = np.nan
    got = official.describe5(spark.createDataFrame(frame), ["a", "b", "c"]).toPandas().set_index("metric")
    want = frame.describe(percentiles=[0, 0.25, 0.5, 0.75, 1]).round(2)
    for ours, theirs in [("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("q0", "0%"),
                         ("q25", "25%"), ("q50", "50%"), ("q75", "75%"), ("q100", "100%"), ("max", "max")]:
        for c in "abc":
            assert got.loc[c, ours] == pytest.approx(want.loc[theirs, c], rel=1e-12), (c, ours)


def test_single_row_has_no_deviation(spark):
    row = official.describe5(spark.createDataFrame([(4.0,)], "x double"), ["x"]).first()
    assert row["count"] == 1 and row["std"] is None and row["q25"] == 4.0


def test_running_counts_over_many_slices(spark):
    hist = spark.range(5000).selectExpr("IF(id < 4000, 'hot', 'cold') AS g", "id AS v", "id % 3 + 1 AS n")
    got = official.running_counts(hist, "g", "v").toPandas().sort_values(["g", "v"])
    want = got.groupby("g")["n"].cumsum()
    assert (got["upto"] == want).all() and len(got) == 5000


def test_outliers_use_one_summary_and_keep_nulls(spark):
    rows = [(i, float(i % 10), float(i % 7)) for i in range(200)]
    rows += [(1000, 500.0, 3.0), (1001, 5.0, -400.0), (1002, None, 3.0), (1003, float("nan"), 3.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    kept = {r.id for r in official.drop_outliers(df, ["a", "b"]).collect()}
    assert kept == set(range(200)) | {1002, 1003}


def test_zero_fill_leaves_text_alone(spark):
    df = spark.createDataFrame([(None, None)], "n double, t string")
    assert tuple(filters.fill_zero(df, ["n"]).first()) == (0.0, None)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_salted_join_equals_plain_join(spark, how):
    left = spark.range(3000).selectExpr(
        "id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'k' || (id % 50) END AS k"
    )
    right = spark.createDataFrame(
        [("hot", 1), ("hot", 2), ("k1", 3), ("k2", 4), ("unused", 5)], "k string, v int"
    )
    got = skew.salted_join(left, right, "k", ["id"], how, salts=8).select("id", "k", "v")
    want = left.join(right, "k", how).select("id", "k", "v")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    beyond = skew.lookup_join(left, right, "k", ["id"], how, max_rows=2).select("id", "k", "v")
    assert beyond.exceptAll(want).count() == 0 and beyond.count() == want.count()


def test_hot_keys_are_few(spark):
    df = spark.range(10_000).selectExpr("IF(id % 2 = 0, 'hot', 'k' || id) AS k")
    assert [r.k for r in skew.hot_keys(df, "k").collect()] == ["hot"]


def test_levels_add_up(spark):
    rows = [("r1", "a", 1), ("r1", "b", 9), (None, "c", 5), (None, "c", 4)]
    posts = spark.createDataFrame(rows, "sal string, id string, score int")
    got = views.view_levels(posts, ["sal", "id"]).collect()
    for level in range(3):
        part = [r for r in got if r.level == level]
        assert sum(r["sum"] for r in part) == 19 and sum(r["count"] for r in part) == 4
    assert [r["sum"] for r in got if r.level == 1 and r.sal is None] == [9]
    assert views.view(posts, ["sal", "id"], level=0).count() == 1


def test_ordered_view(spark):
    posts = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "sal string, score int")
    assert [r.sal for r in views.view(posts, ["sal"], ordered=True).collect()] == ["a", "b"]


def test_topic_views_keep_regions_without_hits(spark):
    posts = spark.createDataFrame(
        [("r1", "police here", 2), ("r1", "fine", 9), ("r2", "new job", 4)], "sal string, content string, score int"
    )
    got = {r.sal: r for r in views.topic_views(posts).collect()}
    assert got["r1"]["count crime"] == 1 and got["r1"]["average_sentiment(sentiment)"] == 5.5
    assert got["r2"]["count crime"] is None and got["r2"]["average_sentiment(crime)"] is None


def test_hierarchy_parents_are_sums(spark):
    rows = [("u1", "a"), ("u1", "b"), ("u1", "b"), (None, "a")]
    got = {r.id: r for r in views.hierarchy(spark.createDataFrame(rows, "u string, g string"), ["u", "g"]).collect()}
    assert got["u1"].value == 3 and got["u1"].parent == "" and got["u1/b"].value == 2 and got["u1/b"].parent == "u1"
    assert got["null/a"].value == 1


def test_regions_keep_their_rows_and_layers_their_ends(spark):
    areas = spark.createDataFrame([("1", "x", "V"), ("2", "y", "V"), ("3", "z", "W")], "code string, name string, state string")
    metrics = spark.createDataFrame([(1, 5.0), (9, 1.0)], "code int, m double")
    joined = regions.region_metrics(areas, {"m": metrics}, "code")
    assert joined.count() == 3
    layers = regions.metric_layers(joined, ["code"], ["m"]).collect()
    assert {(r.code, r.z, r.zmin, r.zmax) for r in layers} == {("1", 5.0, 5.0, 5.0), ("2", None, 5.0, 5.0), ("3", None, 5.0, 5.0)}


def test_unmatched_codes_vanish(spark):
    official_rows = spark.createDataFrame([(1, 5.0), (4, 1.0)], "` code` int, m double")
    areas = spark.createDataFrame([("1", "x"), ("bad", "y")], "code string, name string")
    got = regions.join_regions(official_rows, areas, " code", "code").collect()
    assert [(r.code, r.name, r.m) for r in got] == [(1, "x", 5.0)]


def stored(spark):
    return spark.createDataFrame([("a", 1, "x", 1), ("b", 2, "y", 3)], "_id string, n int, t string, version bigint")


def test_upsert(spark):
    updates = spark.createDataFrame([("b", 20, "q", 1), ("c", 30, "w", 2), ("c", 31, "e", 3)], "_id string, n int, t string, ord int")
    got = {r._id: (r.n, r.t, r.version) for r in docstore.upsert(stored(spark), updates, order_col="ord").collect()}
    assert got == {"a": (1, "x", 1), "b": (20, "q", 4), "c": (31, "e", 2)}


def test_bulk_insert_rejects_known_and_repeated_ids(spark):
    new = spark.createDataFrame([("b", 9, "z", 1), ("c", 1, "first", 2), ("c", 2, "second", 3), ("d", 4, "d", 4)], "_id string, n int, t string, ord int")
    inserted, conflicts = docstore.bulk_insert(stored(spark).drop("version"), new, order_col="ord")
    assert {(r._id, r.t) for r in inserted.collect()} == {("c", "first"), ("d", "d")}
    assert {(r._id, r.rejected) for r in conflicts.collect()} == {("b", 1), ("c", 1)}


def test_generated_ids_stay(spark):
    named = docstore.with_generated_ids(spark.createDataFrame([("a",), (None,), (None,)], "_id string"))
    first, second = ({r._id for r in named.collect()} for _ in range(2))
    assert first == second and len(first) == 3 and None not in first


def test_patch_overwrites_only_named_fields(spark):
    rows = [
        ("a", None, "newer", ["t"], 2), ("a", None, "new", ["t"], 1), ("a", 5, "no", ["n"], 3),
        ("b", None, None, ["n", "t"], 1), ("zz", 1, "q", ["n"], 1), ("zz", 2, "q", ["n"], 2),
    ]
    patches = spark.createDataFrame(rows, "_id string, n int, t string, fields array<string>, ord int")
    patched, missing = docstore.patch(stored(spark), patches, "ord")
    assert {r._id: (r.n, r.t, r.version) for r in patched.collect()} == {"a": (5, "newer", 4), "b": (None, None, 4)}
    assert patched.count() == 2
    assert [r._id for r in missing.collect()] == ["zz"]


def test_bulk_insert_gives_ids_and_versions(spark):
    new = spark.createDataFrame([(None, 1, "x"), (None, 1, "x"), ("b", 2, "y"), ("e", 3, "z")], "_id string, n int, t string")
    inserted, conflicts = docstore.bulk_insert(stored(spark), new)
    got = inserted.collect()
    assert len(got) == 3 and len({r._id for r in got}) == 3 and {r.version for r in got} == {1}
    assert [(r._id, r.rejected) for r in conflicts.collect()] == [("b", 1)]


def test_get_and_delete(spark):
    ids = spark.createDataFrame([("b",), ("q",), ("q",)], "_id string")
    assert [r._id for r in docstore.get_documents(stored(spark), ids).collect()] == ["b"]
    left, missing = docstore.delete_documents(stored(spark), ids)
    assert [r._id for r in left.collect()] == ["a"] and [r._id for r in missing.collect()] == ["q"]


def test_pages(spark):
    ids = spark.range(100).selectExpr("id * 10 AS tid")
    assert [r.tid for r in paging.page_after(ids, 400).collect()] == [410 + 10 * i for i in range(40)]
    assert paging.page_after(ids, 990).count() == 0
    assert [r.tid for r in paging.page_before(ids, 400).collect()] == [390]


def test_next_pages_cut_early(spark):
    source = spark.range(1000).selectExpr("IF(id % 3 = 0, 'a', 'b') AS server", "id AS tid")
    stored = spark.createDataFrame([("a", 500)], "server string, tid bigint")
    page = paging.next_pages(source, stored)
    got = sorted((r.server, r.tid) for r in page.collect())
    want = [("a", i) for i in range(501, 621, 3)] + [("b", i) for i in range(1000) if i % 3][:40]
    assert got == sorted(want)
    assert "WindowGroupLimit" in page._jdf.queryExecution().executedPlan().toString()


def test_invalid_places(spark):
    df = spark.createDataFrame([("vic australia",), ("carlton vic",), (None,)], "place string")
    assert [r.place for r in filters.without_invalid_places(df).collect()] == ["carlton vic", None]


def test_extremes_and_bands(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 5.0), ("c", 1.0), ("d", None)], "name string, m double")
    row = official.extremes(df, "name", ["m"]).first()
    assert (row.highest, row.highest_value, row.lowest, row.lowest_value) == ("a", 5.0, "c", 1.0)
    counts = spark.createDataFrame([(1,), (10,), (11,), (100,), (101,), (0,)], "count int")
    got = {r.band: (r.regions, r["share"]) for r in official.count_bands(counts).collect()}
    assert got == {"1-10": (2, 40.0), "10-100": (2, 40.0), ">100": (1, 20.0)}


def test_states_give_every_level_and_batch(spark, tmp_path):
    from geopulse.operators import states

    random.seed(6)
    rows = [(random.choice([None, "a", "b"]), random.choice(["x", "y", None]), random.choice([None, 1, 5, 9])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k string, l string, score int")
    store = states.StateStore(spark, str(tmp_path / "states"), ["k", "l"], "score")
    store.add(df.limit(0), 0)
    store.add(df.where("score > 1"), 1)
    store.add(df.where("score <= 1 OR score IS NULL"), 2)
    # A batch that runs again replaces itself.
    store.add(df.where("score > 1"), 1)
    for level in range(3):
        want = views.view(df, ["k", "l"], level=level)
        got = store.view(level).select(*want.columns)
        assert got.count() == want.count() and got.exceptAll(want.select(*[F.col(c).cast(got.schema[c].dataType).alias(c) for c in want.columns])).isEmpty()
    levels = store.compact(str(tmp_path / "compact")).levels()
    want = views.view_levels(df, ["k", "l"])
    assert sorted(map(repr, levels.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
    # Coarser levels read states: one row for each key and batch, not the posts.
    assert store.states().count() < 25


def test_reducers_of_ones_own(spark):
    from geopulse.operators import states

    rows = [(i % 3, i % 7, float(i * i % 11)) for i in range(100)] + [(9, 9, 1.0)]
    df = spark.createDataFrame(rows, "k int, l int, v double")
    frame = pd.DataFrame(rows, columns=["k", "l", "v"]).groupby("k")["v"]
    fine = states.states_of(df, ["k", "l"], "v", states.MEAN)
    for r in states.finished(states.merged(fine, ["k"], states.MEAN), states.MEAN).collect():
        own = frame.get_group(r.k)
        assert abs(r["mean"] - own.mean()) < 1e-9 and (r["std"] is None if len(own) < 2 else abs(r["std"] - own.std()) < 1e-9)
    fine = states.states_of(df, ["k", "l"], "v", states.DISTINCT)
    assert {r.k: r.distinct for r in states.finished(states.merged(fine, ["k"], states.DISTINCT), states.DISTINCT).collect()} == frame.nunique().to_dict()
    spread = states.Reducer(lambda x: {"lo": F.min(x), "hi": F.max(x)}, lambda s: {"lo": F.min(s["lo"]), "hi": F.max(s["hi"])}, lambda s: {"spread": s["hi"] - s["lo"]})
    whole = states.finished(states.merged(states.states_of(df, ["k", "l"], "v", spread), [], spread), spread)
    values = [v for *_, v in rows]
    assert whole.first().spread == max(values) - min(values)
