import json

import pytest
from pyspark.sql import functions as F

from geopulse.operators.gazetteer import build_gazetteer
from geopulse.operators.language import train_lang
from geopulse.plans.jobs import Enrichers, crime_table, gazetteer_job, income_table, ingest_job, ingest_posts
from geopulse.operators.sentiment import normalise_text, polarity
from geopulse.schemas import POST_COLUMNS
from geopulse.sources import posts as post_source
from geopulse.sources import sinks, tables
from geopulse.streaming import harvest, live_view


def line(tid, text="fine day", place=None, author="7", date="2022-02-10T04:47:05.000Z"):
    data = {"author_id": author, "created_at": date, "text": text}
    doc = {"_id": tid, "data": {k: v for k, v in data.items() if v is not None}}
    if place:
        doc["includes"] = {"places": [{"full_name": place}]}
    body = {"id": tid, "key": [2022, "x"], "value": {"tags": "a|b", "tokens": "a|b"}, "doc": doc}
    return json.dumps(body, separators=(",", ":"), ensure_ascii=False) + ","


LINES = [
    '{"total_rows":3,"offset":0,"rows":[',
    line("100000000000001", "good @ann #x https://a.b/c Cats", "Middle Park, Victoria"),
    line("10000000000002", "id of 14 digits"),
    line("100000000000003", "@only #tags"),
    line("100000000000004", "no author", author=None),
    line("100000000000005", 'he said "no" to bad', "Nowhere"),
    line("100000000000006", None, "Middle Park"),
    line("100000000000007", "bad place is missing"),
    "]}",
]


@pytest.fixture(scope="module")
def steps(spark):
    return make_steps(spark)


def make_steps(spark, **options):
    places = spark.createDataFrame([(1, "middle park", "2gmel", "21640"), (2, "vic", "2rvic", "2")], "ord int, location string, gcc string, sal string")
    return Enrichers.from_tables(
        spark.createDataFrame([("Cats", "cat")], "token string, lemma string"),
        spark.createDataFrame([("good", 30), ("bad", -30)], "token string, valence int"),
        train_lang(spark.createDataFrame([("good bad no place fine day", "en")], "t string, l string"), "t", "l"),
        build_gazetteer(places),
        **options,
    )


def test_raw_fields_stop_at_the_first_quote_and_json_fields_do_not(spark):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    raw = {r.tid: r for r in post_source.extract_fields(lines).collect()}
    parsed = {r.tid: r for r in post_source.extract_fields(lines, "json").collect()}
    assert set(raw) == set(parsed) and len(raw) == 7
    assert raw["100000000000005"].text == "he said \\"
    assert parsed["100000000000005"].text == 'he said "no" to bad'
    assert raw["100000000000004"].author is None and raw["100000000000006"].text is None
    assert raw["100000000000001"].location == parsed["100000000000001"].location == "Middle Park, Victoria"


def test_a_line_is_searched_once_for_each_field(spark, steps):
    end = line("100000000000009", "one\u2028two").replace("\\u2028", "\u2028")
    lines = spark.createDataFrame([(line("100000000000001"),), (line("100000000000008", text=""),), (end,)], "value string")
    found = {r.tid[-1]: r.text for r in post_source.extract_fields(lines).collect()}
    # A value ends at its quote in the same line.
    assert found == {"1": "fine day", "8": "", "9": None}
    # Filters of the text do not search for it again below.
    plan = ingest_posts(lines, steps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('"text":"') == 1 and plan.count("https?") == 1


def test_ingest(spark, steps):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    got = {r.tid[-1]: r for r in ingest_posts(lines, steps).collect()}
    assert set(got) == {"1", "5", "7"}
    # A single known word beats the longer full name.
    assert got["1"].content == "good cat" and got["1"].sal == "2" and got["1"].lang == "en" and got["1"].score == 8
    assert got["1"]._id.split(":")[1] == "100000000000001" and got["1"]._id[0] in "0123"
    assert got["5"].sal is None and got["7"].score == 2
    geo = ingest_posts(lines, steps, geo_only=True).collect()
    assert [r.tid[-1] for r in geo] == ["1"]


def test_ingest_without_models_in_memory_needs_no_shuffle(spark, steps):
    lines = spark.createDataFrame([(x,) for x in LINES], "value string")
    plan = ingest_posts(lines, steps)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_large_models_are_joined_with_the_same_result(spark, steps, tmp_path):
    lines = spark.createDataFrame([(x,) for x in LINES * 30], "value string")
    joined = make_steps(spark, max_rows=0)
    small, large = ingest_posts(lines, steps), ingest_posts(lines, joined).select(*POST_COLUMNS)
    assert small.count() == 90 and small.exceptAll(large).count() == 0 and large.exceptAll(small).count() == 0
    drop(tmp_path / "in", "1.json", [status("AU", 2), status("SOCIAL", 2, "<p>bad</p>")])
    stream = harvest.harvest_stream(spark, str(tmp_path / "in"))
    store = str(tmp_path / "store")
    harvest.run_harvest(spark, stream, joined, store, str(tmp_path / "marks")).awaitTermination()
    assert sorted((r.server, r.score) for r in spark.read.parquet(store).collect()) == [("AU", 8), ("SOCIAL", 2)]


def test_repeated_ids_with_other_texts_and_repeated_model_keys(spark):
    """Rows that share an id are scored each by itself, whatever way the models take."""
    posts = spark.createDataFrame([("1", "good cat", 0), ("1", "bad cats", 1), ("1", None, 2), ("2", "", 3)], "tid string, text string, at int")
    lemmas = spark.createDataFrame([("cats", "dog"), ("cats", "cat")], "token string, lemma string")
    lexicon = spark.createDataFrame([("good", 20), ("good", 5), ("bad", -30)], "token string, valence int")
    found = []
    for max_rows in (1000, 0):
        done = normalise_text(posts, "text", lemmas, ["tid"], max_rows=max_rows)
        plain = polarity(done, "content", lexicon, ["tid"], max_rows=max_rows)
        both = polarity(plain, "content", lexicon, ["tid"], "ruled", rules=True, max_rows=max_rows)
        assert both.columns == ["tid", "text", "at", "content", "compound", "ruled"]
        found.append(sorted(map(tuple, both.collect()), key=lambda r: r[2]))
    assert found[0] == found[1] and [r[3] for r in found[0]] == ["good cat", "bad cat", None, ""]
    assert found[0][0][4] == pytest.approx(0.5 / (0.25 + 15) ** 0.5)


def test_joined_models_read_the_dump_once(spark, tmp_path):
    path = tmp_path / "dump.json"
    path.write_text("\n".join(LINES))
    posts = ingest_posts(post_source.read_post_lines(spark, str(path)), make_steps(spark, max_rows=0))
    # The dump is read by the step that writes the posts down; what comes after reads from there.
    assert "FileScan text" not in posts._jdf.queryExecution().executedPlan().toString()


def test_topic_flags_lower_the_text_once(spark):
    from geopulse.operators.views import topic_split, topic_views
    from geopulse.plans.jobs import score_distributions

    schema = "sal string, content string, score int"
    posts = spark.createDataFrame([("1", "Police WORK", 3), ("2", None, 4)], schema)
    for df in (topic_views(posts), topic_split(posts, "crime"), score_distributions({"p": posts}, {"p": ["crime", "income"]})):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert [(r.title, r["count"]) for r in topic_split(posts, "crime").collect()] == [("CrimeMentioned", 1)]
    # The split has its own list: "criminal" is not in it.
    other = spark.createDataFrame([("1", "a criminal", 3)], schema)
    assert topic_split(other, "crime").first().title == "CrimeAbsent"


def test_ingest_twice_stores_each_id_once(spark, steps, tmp_path):
    store = str(tmp_path / "store")
    for name, lines in (("a", LINES * 2), ("b", LINES)):
        path = tmp_path / f"{name}.json"
        path.write_text("\n".join(lines))
        rejected = ingest_job(spark, str(path), store, steps)
        assert {r.rejected for r in rejected.collect()} == {1}
    back = spark.read.parquet(store)
    assert back.count() == back.select("_id").distinct().count() == 3


def test_stored_and_repeated_posts_are_not_enriched_again(spark, steps, tmp_path):
    from dataclasses import replace

    store, seen = str(tmp_path / "store"), spark.sparkContext.accumulator(0)

    def counted(df, text, key, out):
        @F.udf("string")
        def count(x):
            seen.add(1)
            return x

        return steps.normaliser(df.withColumn(text, count(text)), text, key, out)

    counting = replace(steps, normaliser=counted)
    # Copies that differ are compared by what they become.
    other = line("100000000000001", "bad cats", "Middle Park, Victoria")
    for name, lines, runs in (("a", LINES * 2 + [other], 4), ("b", [*LINES, other], 0)):
        path, before = tmp_path / f"{name}.json", seen.value
        path.write_text("\n".join(lines))
        rejected = {r._id[2:]: r.rejected for r in ingest_job(spark, str(path), store, counting).collect()}
        assert seen.value - before == runs
    assert rejected == {"100000000000001": 2, "100000000000005": 1, "100000000000007": 1}
    back = {r.tid: r.content for r in spark.read.parquet(store).collect()}
    assert back == {"100000000000001": "bad cats", "100000000000005": "he said \\", "100000000000007": "bad place is missing"}


def test_poison_references_do_not_end_the_harvest(spark, steps, tmp_path):
    drop(tmp_path / "in", "1.json", [status("AU", 2, "<p>good &#9999999; &#xD800;&#0000000065;</p>")])
    stream = harvest.harvest_stream(spark, str(tmp_path / "in"))
    store = str(tmp_path / "store")
    harvest.run_harvest(spark, stream, steps, store, str(tmp_path / "marks")).awaitTermination()
    assert spark.read.parquet(store).first().content == "good \ufffd \ufffd A"


def test_post_array_spacing_rejects_and_empty(spark, tmp_path):
    path = tmp_path / "array.json"
    path.write_text('[{"_id" : "1", "text": "a \\"_id\\": b"}, {\n"_id"\n:"2"}, {"_id": "3", "text": oops}, {"_id": "4"}]')
    posts, rejected = post_source.read_post_array(spark, str(path), mode="PERMISSIVE")
    assert {r._id: r.text for r in posts.collect()} == {"1": 'a "_id": b', "2": None, "4": None}
    assert rejected.count() == 1
    (tmp_path / "none.json").write_text('[{"id": 1}]')
    with pytest.raises(ValueError):
        post_source.read_post_array(spark, str(tmp_path / "none.json"))
    (tmp_path / "empty.json").write_text("[]")
    assert post_source.read_post_array(spark, str(tmp_path / "empty.json")).count() == 0


def test_compacted_store_is_the_store(spark, steps, tmp_path):
    store, out = str(tmp_path / "store"), str(tmp_path / "compact")
    for i in range(3):
        drop(tmp_path / f"in{i}", "1.json", [status("AU", 10 * i + k, "<p>good</p>") for k in range(5)])
        stream = harvest.harvest_stream(spark, str(tmp_path / f"in{i}"))
        harvest.run_harvest(spark, stream, steps, store, str(tmp_path / f"marks{i}")).awaitTermination()
    harvest.compact_store(spark, store, out)
    before, after = spark.read.parquet(store), spark.read.parquet(out)
    assert before.count() == after.count() == 15 and before.exceptAll(after).isEmpty()
    assert len(after.inputFiles()) == 1 < len(before.inputFiles())


def test_half_written_view_is_not_read(spark, tmp_path):
    schema = "tid string, sal string, content string, lang string, score int"
    out = str(tmp_path / "view")
    for i in range(4):
        spark.createDataFrame([(str(i), "1", "police", "en", i + 1)], schema).write.json(str(tmp_path / "in"), mode="append")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    live_view.run_live_view(live_view.live_view(stream, "crime"), out, str(tmp_path / "marks")).awaitTermination()
    want = live_view.read_live_view(spark, out).collect()
    assert want[0]["count"] == 4
    # A batch that began and did not end: a folder without a commit.
    live_view.read_live_view(spark, out).limit(0).write.parquet(f"{out}/batch=99")
    assert live_view.read_live_view(spark, out).collect() == want
    import os

    assert len([x for x in os.listdir(out) if x.startswith("batch=")]) <= 5


def test_ingest_job_reads_split_files_once(spark, steps, tmp_path):
    many = [line(str(200000000000000 + i), f"good text number {i} " * 20, "Middle Park") for i in range(3000)]
    path, store = str(tmp_path / "dump.json"), str(tmp_path / "store")
    (tmp_path / "dump.json").write_text("\n".join(["header", *many, "footer"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        assert post_source.read_post_lines(spark, path).rdd.getNumPartitions() > 4
        ingest_job(spark, path, store, steps)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    back = spark.read.parquet(store)
    assert back.count() == 3000 and back.select("tid").distinct().count() == 3000
    assert {r.partition for r in back.select("partition").distinct().collect()} == {0, 1, 2, 3}


def test_post_array_keeps_places_with_their_posts(spark, tmp_path):
    objects = [{"_id": str(i), "author_id": "a", "created_at": "d", "text": f'say "_id": "{i}" }},{{ [x]'} for i in range(500)]
    for o in objects[1::2]:
        o["full_name"] = f"Place {o['_id']}"
    path = tmp_path / "array.json"
    path.write_text(json.dumps(objects, indent=2))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = {r._id: r for r in post_source.read_post_array(spark, str(path)).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 500
    for o in objects:
        assert got[o["_id"]].text == o["text"] and got[o["_id"]].full_name == o.get("full_name")


@pytest.mark.parametrize("indent", [None, 2])
def test_place_dictionary_keeps_its_order(spark, tmp_path, indent):
    names = {f"name {i} (vic.)": {"ste": "2", "gcc": "g", "sal": str(i)} for i in range(400)}
    path = tmp_path / "sal.json"
    path.write_text(json.dumps(names, indent=indent))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5k")
    try:
        got = tables.read_place_dict(spark, str(path)).orderBy("ord").collect()
        gazetteer = {r.location: r.sal for r in gazetteer_job(spark, str(path), str(tmp_path / "g")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.location for r in got] == list(names)
    # A pair of two words shared by one name only, and one where the last name wins.
    assert gazetteer["name 7"] == "7" and gazetteer["name 399 vic"] == "399"


def test_official_csv_keeps_blanks_in_names(spark, tmp_path):
    (tmp_path / "c.csv").write_text("area, code, mean_aud\n1,20,3.5\n2,,\n")
    df = tables.read_official_csv(spark, str(tmp_path / "c.csv"))
    assert df.columns == ["area", " code", " mean_aud"] and df.count() == 2


def test_json_arrays_and_gzip(spark, tmp_path):
    df = spark.range(100).selectExpr("id", "IF(id = 3, NULL, 'é') AS t").repartition(3)
    sinks.write_json_array(df, str(tmp_path / "a"))
    rows = [r for f in (tmp_path / "a").glob("part*") for r in json.loads(f.read_text())]
    assert len(rows) == 100 and {"id": 3, "t": None} in rows
    sinks.write_json(df, str(tmp_path / "z"), compression="gzip")
    assert list((tmp_path / "z").glob("*.json.gz"))


def test_batches(spark, tmp_path):
    sinks.write_batched(spark.range(2500).coalesce(1), str(tmp_path / "b"), n=1000)
    assert len(list((tmp_path / "b").glob("part*"))) == 3
    out = str(tmp_path / "sent")

    def send(batch):
        with open(out, "a") as f:
            f.write(f"{len(batch)}\n")

    sinks.upload_batched(spark.range(2500).coalesce(1), send)
    assert open(out).read().split() == ["1000", "1000", "500"]


def test_materialise(spark, tmp_path):
    path = str(tmp_path / "m")
    assert sinks.materialise(spark.range(3), path).count() == 3
    assert sinks.materialise(spark.range(9), path).count() == 3
    assert sinks.materialise(spark.range(9), path, force=True).count() == 9


def test_crime_table(spark):
    rows = [(i % 20, "n", float(i % 20), 1.0) for i in range(100)] + [(21, None, None, 1.0), (22, "far", 900.0, 1.0)]
    raw = spark.createDataFrame(rows, "` code` int, ` name` string, ` a` double, ` b` double")
    got = {r[" code"]: r for r in crime_table(raw, {" a": "x", " b": "y"}, "total").collect()}
    assert len(got) == 21 and 22 not in got
    assert got[21].x == 0.0 and got[21].total == 1.0 and got[21][" name"] is None


def test_income_fences_ignore_other_states(spark):
    rows = [(i, float(i), 10.0) for i in range(1, 21)] + [(30, 500.0, 10.0), (31, 19.0, 9999.0), (32, None, 1.0), (40, 10_000.0, 1.0), (41, 90_000.0, 1.0)]
    raw = spark.createDataFrame(rows, "code int, m double, age double")
    areas = spark.createDataFrame([(str(r[0]), "W" if r[0] >= 40 else "V") for r in rows], "code string, state string")
    got = {r.code for r in income_table(raw.unionAll(raw), areas, "code", "code", "state", "V", ["m", "age"], ["m"]).collect()}
    assert got == set(range(1, 21)) | {31}


def status(server, tid, content="<p>good</p>"):
    return {"server": server, "id": tid, "created_at": "2023-05-01T00:00:00Z", "language": "en",
            "content": content, "account": {"id": 5}, "tags": ["a", "b"]}


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def test_harvest_stores_each_toot_once(spark, steps, tmp_path):
    arrived, store, marks = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "marks")
    drop(arrived, "1.json", [status("AU", 2), status("AU", 1), status("SOCIAL", 1, "<p>bad &amp; bad</p>")])
    drop(arrived, "empty.json", [])

    def run(checkpoint):
        stream = harvest.harvest_stream(spark, str(arrived), files_per_trigger=1)
        harvest.run_harvest(spark, stream, steps, store, checkpoint).awaitTermination()
        return sorted((r.server, r.tid, r.score) for r in spark.read.parquet(store).collect())

    first = run(marks)
    assert first == [("AU", 1, 8), ("AU", 2, 8), ("SOCIAL", 1, 1)]
    drop(arrived, "2.json", [status("AU", 2), status("AU", 3), status("AU", 3)])
    second = run(marks)
    assert [x[:2] for x in second] == [("AU", 1), ("AU", 2), ("AU", 3), ("SOCIAL", 1)]
    # All files once more under a new checkpoint: a replay adds nothing.
    assert run(str(tmp_path / "other")) == second
    stored = spark.read.parquet(store).where("server = 'SOCIAL'").first()
    assert (stored.date, stored.author, stored.content, stored.tags) == ("2023-05-01T00:00:00.000Z", "5", "bad & bad", "a|b")


def test_polling_passes_drain_the_source(spark, steps, tmp_path):
    from geopulse.schemas import STATUS

    rows = [("AU", i) for i in range(1, 95)] + [("SOCIAL", i) for i in range(3)]
    folder = tmp_path / "statuses"
    drop(folder, "all.json", [status(s, i) for s, i in rows])
    source, store = spark.read.schema(STATUS).json(str(folder)), str(tmp_path / "store")
    assert [harvest.harvest_pass(source, steps, store) for _ in range(4)] == [43, 40, 14, 0]
    stored = spark.read.parquet(store)
    assert sorted((r.server, r.tid) for r in stored.collect()) == sorted(rows)


def test_live_view_equals_batch_view(spark, tmp_path):
    arrived, out = tmp_path / "in", str(tmp_path / "view")
    rows = [{"sal": f"r{i % 3}", "content": "police" if i % 2 else "calm", "score": i % 9 + 1} for i in range(60)]
    schema = "sal STRING, content STRING, score INT"
    for part in range(3):
        drop(arrived, f"{part}.json", rows[part::3])

        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(arrived))
        view = live_view.live_view(stream, "crime")
        live_view.run_live_view(view, out, str(tmp_path / "marks")).awaitTermination()
    got = live_view.read_live_view(spark, out)
    batch = live_view.live_view(spark.createDataFrame(rows, schema), "crime")
    assert got.count() == 3 and got.select(*batch.columns).exceptAll(batch).count() == 0
