"""Words of many texts at a time: dictionaries in the tasks, and blocks of texts that meet a large model."""

import glob
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from geopulse import session
from geopulse.functions import batches
from geopulse.operators import language, sentiment
from geopulse.plans import blocks
from geopulse.plans.skew import with_row_id
from geopulse.queries.registry import QUERIES
from geopulse.session import shared_dir


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def posts(spark):
    rng = random.Random(8)
    words = ["good", "bad", "very", "not", "GOOD", "but", "und", "die", "Ünd", "isn't", "it!", "...", "ok?", "plain"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(200)]
    return spark.createDataFrame(rows + [(1, "good " * 5000), (1, ""), (1, None), (None, " \t ")], "id int, text string")


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame([("good", 19), ("bad", -25), ("ok", 9), ("die", 7)], "token string, valence int")


# tokens were shuffled one by one, with the number of their row.
def test_words_meet_a_large_model_once_per_block(spark, posts, lexicon):
    lemmas = lexicon.select("token", F.lit("x").alias("lemma"))
    profiles = language.train_lang(posts.withColumn("lang", F.lit("aa")), "text", "lang")
    for done in (
        sentiment.normalise_text(posts, "text", lemmas, ["id"], max_rows=0),
        sentiment.polarity(posts, "text", lexicon, ["id"], max_rows=0),
        sentiment.polarity(posts, "text", lexicon, ["id"], rules=True, max_rows=0),
        language.detect_lang(posts, "text", profiles, ["id"], max_rows=0),
    ):
        plan = plan_of(done)
        assert "FlatMapCoGroupsInArrow" in plan and "posexplode" not in plan and "_row" not in done.columns
        assert done.count() == posts.count()


def test_blocks_are_bounded_in_bytes_and_rows(spark):
    rows = spark.range(0, 20_000, 1, 1).withColumn("_row", F.monotonically_increasing_id())
    text = F.expr("CASE WHEN id % 500 = 0 THEN repeat('x', 3000000) WHEN id > 15000 THEN NULL ELSE repeat('y', 3000) END")
    rows = rows.withColumn("text", text).withColumn("block", blocks.block_of("_row", "text"))
    sizes = rows.groupBy("block").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"), F.count("*").alias("n"))
    bytes_, n = sizes.agg(F.max("bytes"), F.max("n")).first()
    assert bytes_ <= 1 << blocks.BLOCK_BITS and n <= 1 << blocks.ROWS_BITS
    assert sizes.count() < 200


# F5, F7, F8: arrays of structs went through interpreted lambdas, some ten microseconds a word.
def test_words_of_small_models_go_through_no_interpreted_loop(spark, posts, lexicon):
    phrases = spark.createDataFrame([("und die", 5), ("not very good", -40)], "phrase string, valence int")
    whole = sentiment.FullScorer(lexicon, phrases).score(posts, "text", ["id"])
    ruled = sentiment.polarity(posts, "text", lexicon, ["id"], rules=True)
    for done in (whole, ruled, sentiment.polarity(posts, "text", lexicon, ["id"])):
        plan = plan_of(done)
        assert "ArrowEvalPython" in plan and "aggregate(" not in plan and "Exchange" not in plan


def test_whole_score_is_the_same_by_dictionary_and_by_blocks(spark, posts, lexicon):
    phrases = spark.createDataFrame([("und die", 5), ("not very good", -40)], "phrase string, valence int")
    small = sentiment.FullScorer(lexicon, phrases).score(posts, "text", ["id"])
    large = sentiment.FullScorer(lexicon, phrases, max_rows=0).score(posts, "text", ["id"])
    assert small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    assert small.where("compound IS NULL").count() == 1 and small.where("compound = 0").count() >= 2


def test_chunks_of_words_do_not_change_sums():
    texts = ["very good not bad", None, "good", "", "not very good very"] * 50
    table, parts = {"good": 19, "bad": -25}, {"very": 1, "not": 2}
    work = batches.rule_sums(parts, 2, [293_000, 278_350, 263_700], [1_000_000, -740_000, 547_600, -405_224], 1_000_000, 100_000_000)
    whole = work(texts, table)
    assert whole == [v for t in texts for v in work([t], table)] and whole[1] is None and whole[3] == 0
    assert whole[0] == 190_000_000 + 29_300_000 + (-250_000_000 - 26_370_000) * -740_000 // 1_000_000


# the lemma table was made a second time to see whether a lemma is blank.
def test_blank_lemmas_are_seen_without_another_look_at_the_table(spark):
    for lemma, found in (("be", False), ("", True), ("  ", True)):
        table = spark.createDataFrame([("is", lemma), ("was", None)], "token string, lemma string")
        assert [sentiment.Normaliser(table, n).blanks() for n in (100, 0)] == [found, found]


# all posts went through three tasks.
def test_stream_view_writes_files_that_do_not_grow_with_the_posts(spark, tmp_path):
    rows = spark.range(0, 240, 1, 24).selectExpr("id AS doc_id", "'that is work' AS text", "'en' AS lang", "concat('s', id % 3) AS source", "12L AS n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    before = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/posts-*"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", 1 << 10)
    try:
        got = QUERIES["stream_view"](spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got.count() <= 3
    (new,) = set(glob.glob(f"{shared_dir(spark).removeprefix('file:')}/posts-*")) - before
    assert sum(name.startswith("part-") for name in os.listdir(new)) >= 24


def shuffle_files(spark):
    places = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return sum(name.startswith("shuffle_") for place in places for _, _, names in os.walk(place) for name in names)


# shuffle files of all steps lay on the disk until the driver happened to collect its garbage.
def test_shuffle_files_go_when_a_table_is_written(spark):
    name = session.SHUFFLES_GO
    before, setting = shuffle_files(spark), spark.conf.get(name)
    df = spark.range(0, 10_000, 1, 4).groupBy((F.col("id") % 1000).alias("k")).count()
    table = session.written(df, "counted")
    for _ in range(100):
        if shuffle_files(spark) <= before:
            break
        time.sleep(0.1)
    assert shuffle_files(spark) <= before and spark.conf.get(name) == setting
    assert table.count() == 1000
    session.free(table)
    assert not os.path.exists(table.scratch.removeprefix("file:"))


def scratch_bytes(spark, name):
    place = shared_dir(spark).removeprefix("file:")
    return {n: sum(os.path.getsize(f"{place}/{n}/{f}") for f in os.listdir(f"{place}/{n}")) for n in os.listdir(place) if n.startswith(f"{name}-")}


# the shuffles and rows of all texts lay on the disk until the last of them was done.
def test_slices_of_texts_change_nothing_and_go_when_done(spark, posts, lexicon, monkeypatch):
    df = posts.repartition(6, "text")
    lemmas = spark.createDataFrame([("good", "fine"), ("bad", "ill")], "token string, lemma string")
    profiles = language.train_lang(df.withColumn("lang", F.substring("text", 1, 1)), "text", "lang")

    def all_steps():
        return [
            sentiment.normalise_text(df, "text", lemmas, ["id"], "text", max_rows=0),
            sentiment.normalise_text(df, "text", lemmas, ["id"], max_rows=0),
            sentiment.polarity(df, "text", lexicon, ["id"], rules=True, max_rows=0),
            language.detect_lang(df, "text", profiles, ["id"], max_rows=0),
        ]

    whole = [done.collect() for done in all_steps()]
    monkeypatch.setattr(blocks, "SLICE_BYTES", 1)
    before, shuffles = scratch_bytes(spark, "rows"), shuffle_files(spark)
    sliced = all_steps()
    for _ in range(100):
        if shuffle_files(spark) <= shuffles:
            break
        time.sleep(0.1)
    # Nothing is left but what was made; no frame has to be made again from its texts.
    assert shuffle_files(spark) <= shuffles and len(scratch_bytes(spark, "rows").keys() - before.keys()) == len(sliced)
    for one, other in zip(sliced, whole):
        assert "FlatMapCoGroupsInArrow" not in plan_of(one) and one.columns == list(other[0].__fields__)
        assert sorted(map(repr, one.collect())) == sorted(map(repr, other))


# a table of a caller's own, which it may read again, stays.
def test_only_tables_that_were_handed_over_go(spark, lexicon, monkeypatch):
    monkeypatch.setattr(blocks, "SLICE_BYTES", 1)
    rows = with_row_id(spark.createDataFrame([(i, f"good day {i}", "x") for i in range(40)], "id int, text string, scratch string").repartition(4))
    done = sentiment.polarity(rows, "text", lexicon, ["id"], max_rows=0)
    assert done.count() == rows.count() == 40 and done.columns == [*rows.columns, "compound"]
    again = sentiment.polarity(blocks.hand_over(rows), "text", lexicon, ["id"], max_rows=0)
    assert again.exceptAll(done).count() == 0 and not os.path.exists(rows.scratch.removeprefix("file:"))


def test_slices_are_few_and_hold_all_files(monkeypatch):
    sizes = {f"part-{i}": (i + 1) << 20 for i in range(100)}
    slices = blocks.slices_of(sizes)
    assert len(slices) == blocks.SLICES and sorted(sum(slices, [])) == sorted(sizes)
    assert min(sum(sizes[f] for f in files) for files in slices) >= 500 << 20
    assert blocks.slices_of({"part-0": 1 << 40}) == [["part-0"]] and blocks.slices_of({}) == [[]]
    assert len(blocks.slices_of({"part-0": 70 << 20, "part-1": 70 << 20, "part-2": 1})) == 2


# three tables of all posts with their texts two or three times, the dump as plain text, and shuffles of all steps.
def test_joined_ingest_keeps_no_table_of_a_step_before(spark, monkeypatch, tmp_path):
    rows = spark.range(0, 400, 1, 8).selectExpr("id AS doc_id", "concat('that is work ', id, ' of many words') AS text", "'en' AS lang", "concat('s', id % 3) AS source", "12L AS n_chars")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("nation", "region", "supplier", "customer"):
        if os.path.exists(f"/root/testdata/sf0.001/{name}.parquet"):
            os.symlink(f"/root/testdata/sf0.001/{name}.parquet", f"{tmp_path}/{name}.parquet")
    whole = sorted(map(repr, QUERIES["ingest_posts_joined"](spark, str(tmp_path)).collect()))
    assert len(whole) > 200
    for size, left in ((blocks.SLICE_BYTES, 1), (1, 1)):
        monkeypatch.setattr(blocks, "SLICE_BYTES", size)
        before, dumps = scratch_bytes(spark, "rows"), scratch_bytes(spark, "posts")
        done = QUERIES["ingest_posts_joined"](spark, str(tmp_path))
        new = scratch_bytes(spark, "rows").keys() - before.keys()
        # The table that the result is read or made from.
        assert len(new) == left and "text" not in spark.read.parquet(f"{shared_dir(spark)}/{min(new)}").columns
        assert sorted(map(repr, done.collect())) == whole
        (dump,) = scratch_bytes(spark, "posts").keys() - dumps.keys()
        assert all(n.endswith(".gz") for n in os.listdir(f"{shared_dir(spark).removeprefix('file:')}/{dump}") if n.startswith("part-"))
