"""Paged source, incremental view, key index, feature collections, array files, correlations."""

import glob
import json
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from geopulse.operators import docstore, official
from geopulse.operators.keyindex import KeyIndex
from geopulse.plans.jobs import Enrichers, ingest_job
from geopulse.schemas import STATUS
from geopulse.sources import geojson, paged, tables
from geopulse.sources.files import Folder
from geopulse.streaming import array_sink, harvest, live_view
from test_pipelines import line, make_steps


# --- paged source --------------------------------------------------------------------------------


def statuses(spark, keys):
    rows = [(server, i, None, "en", f"<p>good {i}</p>", (5,), ["a"]) for server, i in keys]
    return spark.createDataFrame(rows, STATUS)


def toot_steps(spark, **options):
    return Enrichers.from_tables(
        spark.createDataFrame([("Cats", "cat")], "token string, lemma string"),
        spark.createDataFrame([("good", 30), ("bad", -30)], "token string, valence int"),
        **options,
    )


class Seen:
    """The batches of a paged stream, as lists of (server, id)."""

    def __init__(self, spark, pages, marks, page, **options):
        self.make = lambda: paged.paged_statuses(spark, pages, page, **options)
        self.marks, self.batches, self.parts = marks, [], []

    def run(self):
        def hear(batch, number):
            self.parts.append(batch.rdd.getNumPartitions())
            self.batches.append([(r.server, r.id) for r in batch.collect()])

        stream = self.make().writeStream.foreachBatch(hear).option("checkpointLocation", self.marks)
        harvest.drain(stream.trigger(processingTime="0 seconds").start())
        done, self.batches = self.batches, []
        return done


def test_pages_go_on_from_the_checkpoint(spark, tmp_path):
    pages, keys = str(tmp_path / "pages"), [("AU", i) for i in range(1, 96)] + [("a/b =c", i) for i in range(7)] + [("SOCIAL", 5)] * 3
    random.Random(1).shuffle(keys)
    paged.write_pages(statuses(spark, keys), pages)
    seen = Seen(spark, pages, str(tmp_path / "marks"), 40)
    first = seen.run()
    # At most a page of each server and batch, in order; every status once. Rows of one id stay together.
    assert [len(b) for b in first] == [40 + 7 + 3, 40, 15]
    assert sorted(x for b in first for x in b) == sorted(keys)
    assert all(max(i for s, i in a if s == "AU") < min(i for s, i in b if s == "AU") for a, b in zip(first, first[1:]))
    # Nothing new is no batch, and nothing is read twice after a restart.
    assert seen.run() == []
    paged.write_pages(statuses(spark, [("AU", 200), ("NEW", 1), ("AU", 3), ("SOCIAL", 5)]), pages)
    assert [sorted(b) for b in seen.run()] == [[("AU", 200), ("NEW", 1)]]


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    pages, marks = str(tmp_path / "pages"), str(tmp_path / "marks")
    paged.write_pages(statuses(spark, [("AU", i) for i in range(100)]), pages)
    seen = []

    def run(fail):
        def hear(batch, number):
            got = sorted(r.id for r in batch.collect())
            seen.append((number, got))
            if number == fail:
                raise ValueError("ended here")

        stream = paged.paged_statuses(spark, pages, 30).writeStream.foreachBatch(hear).option("checkpointLocation", marks)
        harvest.drain(stream.trigger(processingTime="0 seconds").start())

    with pytest.raises(Exception):
        run(fail=1)
    run(fail=None)
    assert seen[1] == seen[2] == (1, list(range(30, 60)))
    assert [n for n, _ in seen] == [0, 1, 1, 2, 3] and sum(len(x) for n, x in seen[2:]) == 70


def test_a_page_is_cut_into_tasks_and_reads_few_row_groups(spark, tmp_path):
    pages = str(tmp_path / "pages")
    paged.write_pages(statuses(spark, [("hot", i) for i in range(1000)] + [("cold", 1)]), pages, file_rows=100)
    client = paged.ParquetPages(pages)
    assert client.servers() == ["cold", "hot"] and client.page_end("hot", 499, 100) == 599
    parts = client.parts("hot", 499, 599, 30)
    assert [(a, b) for a, b, _ in parts] == [(499, 529), (529, 559), (559, 589), (589, 599)]
    assert all(len(pieces) <= 2 for *_, pieces in parts) and len(client.groups("hot")) >= 10
    assert client.page_end("hot", 999, 10) is None
    seen = Seen(spark, pages, str(tmp_path / "marks"), 400, task_rows=100)
    assert [len(b) for b in seen.run()] == [401, 400, 200] and seen.parts == [5, 4, 2]


def test_pages_without_a_folder_and_null_ids(spark, tmp_path):
    pages = str(tmp_path / "pages")
    # A stream's first batch may be empty; there is no second one.
    seen = Seen(spark, pages, str(tmp_path / "m1"), 40)
    assert seen.run() == [[]] and seen.run() == []
    paged.write_pages(statuses(spark, [("AU", None), ("AU", 4), (None, 5)]), pages)
    assert Seen(spark, pages, str(tmp_path / "m2"), 40).run() == [[("AU", 4)]]


def test_a_source_may_bring_its_own_client(spark, tmp_path):
    import pyarrow as pa

    class Counter:
        """Two servers whose statuses are numbers."""

        def servers(self):
            return ["even", "odd"]

        def page_end(self, server, after, n):
            ids = [i for i in range(30) if i > after and i % 2 == (server == "odd")][:n]
            return ids[-1] if ids else None

        def parts(self, server, after, upto, n):
            return [(after, upto, None)]

        def read(self, server, after, upto, pieces):
            ids = [i for i in range(30) if after < i <= upto and i % 2 == (server == "odd")]
            yield pa.table({"server": [server] * len(ids), "id": ids})

    class Numbers(paged.PagedStatuses):
        @classmethod
        def name(cls):
            return "numbers"

        def client(self):
            return Counter()

    batches = Seen(spark, "none", str(tmp_path / "marks"), 10, source=Numbers).run()
    assert [len(b) for b in batches] == [20, 10] and sorted(i for b in batches for _, i in b) == list(range(30))


def test_paged_harvest_stores_all_once(spark, tmp_path):
    pages, store, marks = (str(tmp_path / n) for n in ("pages", "store", "marks"))
    steps, keys = toot_steps(spark), [("AU", i) for i in range(90)] + [("B", i) for i in range(3)]
    paged.write_pages(statuses(spark, keys), pages)
    harvest.harvest_pages(spark, pages, steps, store, marks, page=40)
    harvest.harvest_pages(spark, pages, steps, store, marks, page=40)
    stored = spark.read.parquet(store)
    assert sorted((r.server, r.tid) for r in stored.collect()) == keys and {r.score for r in stored.collect()} == {8}


def jobs(spark):
    return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()


def test_models_are_read_once_for_all_batches(spark):
    steps, batch = toot_steps(spark), statuses(spark, [("AU", 1)])
    before = jobs(spark)
    for _ in range(3):
        harvest.enrich_toots(batch, steps)
    assert jobs(spark) == before
    # Joined models are computed and measured when the steps are made: a batch makes jobs of its own only.
    joined = toot_steps(spark, max_rows=0)
    counts = []
    for _ in range(2):
        before = jobs(spark)
        assert harvest.enrich_toots(batch, joined).first().score == 8
        counts.append(jobs(spark) - before)
    before = jobs(spark)
    toot_steps(spark, max_rows=0)
    assert counts[0] == counts[1] and jobs(spark) > before


# --- live view -----------------------------------------------------------------------------------


def post(region, score, content="police"):
    return {"sal": region, "content": content, "score": score}


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in rows))


def run_view(spark, tmp_path, **options):
    stream = spark.readStream.schema("sal STRING, content STRING, score INT").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    view = live_view.live_view(stream, "crime")
    live_view.run_live_view(view, str(tmp_path / "view"), str(tmp_path / "marks"), **options).awaitTermination()
    return {r.sal: r["count"] for r in live_view.read_live_view(spark, str(tmp_path / "view")).collect()}


def buckets(tmp_path):
    return {n: len(glob.glob(f"{tmp_path}/view/batch={n}/_bucket=*")) for n in range(9) if os.path.isdir(f"{tmp_path}/view/batch={n}")}


def test_a_batch_rewrites_the_buckets_it_touches(spark, tmp_path):
    drop(tmp_path / "in", "1.json", [post(f"r{i}", 1) for i in range(40)] + [post(None, 2)])
    first = run_view(spark, tmp_path, keep=10, buckets=16)
    assert len(first) == 41 and buckets(tmp_path)[0] > 10
    drop(tmp_path / "in", "2.json", [post("r7", 3), post("r7", 4), post("r8", 9, "calm")])
    second = run_view(spark, tmp_path, keep=10, buckets=16)
    assert buckets(tmp_path)[1] == 1 and second == first | {"r7": 3}
    drop(tmp_path / "in", "3.json", [post(None, 1), post("new", 1)])
    third = run_view(spark, tmp_path, keep=10, buckets=16)
    assert buckets(tmp_path)[2] <= 2 and third == second | {None: 2, "new": 1}
    # A table stays in its buckets whatever the next run asks for.
    drop(tmp_path / "in", "4.json", [post("r1", 1)])
    assert run_view(spark, tmp_path, keep=10, buckets=99) == third | {"r1": 2}


def test_a_merge_that_runs_again_leaves_the_same(spark, tmp_path):
    store = live_view.ViewStore(spark, str(tmp_path / "view"), ["k"], 4)
    make = lambda rows: spark.createDataFrame(rows, "k string, n long")
    store.merge(make([("a", 1), ("b", 1)]), 0)
    for _ in range(2):
        store.merge(make([("a", 2), (None, 5)]), 1)
        assert sorted(map(tuple, store.read().collect()), key=str) == [("a", 2), ("b", 1), (None, 5)]
    store.merge(make([]), 2)
    assert store.read().count() == 3 and store.commits() == [0, 1, 2]
    # A batch that ended before its commit is not read, and its number may be used again.
    make([("z", 9)]).withColumn("_bucket", F.lit(0)).write.partitionBy("_bucket").parquet(str(tmp_path / "view/batch=3"))
    assert store.read().count() == 3
    store.merge(make([("b", 7)]), 3)
    assert sorted(map(tuple, store.read().collect()), key=str) == [("a", 2), ("b", 7), (None, 5)]
    store.clean(keep=1)
    assert store.commits() == [3] and sorted(map(tuple, store.read().collect()), key=str) == [("a", 2), ("b", 7), (None, 5)]
    with pytest.raises(FileNotFoundError):
        live_view.read_live_view(spark, str(tmp_path / "nothing"))


def test_small_files_are_whole_or_absent(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    assert folder.names() == [] and folder.names("x") == []
    folder.write("a/b.json", "é")
    folder.write("a/b.json", "twice")
    assert folder.read("a/b.json") == "twice" and "b.json" in folder.names("a")
    folder.delete("a")
    folder.delete("a")
    assert "a" not in folder.names()


# --- key index -----------------------------------------------------------------------------------


def store_of(spark, path, batches):
    for keys in batches:
        rows = spark.createDataFrame([(f"{i % 2}:{i}", i % 2) for i in keys], "_id string, partition int")
        rows.coalesce(1).write.mode("append").partitionBy("partition").parquet(path)
    return KeyIndex(spark, path)


def ids_of(spark, keys):
    return spark.createDataFrame([(f"{i % 2}:{i}", i % 2) for i in keys], "_id string, partition int")


def test_index_reads_files_that_may_hold_a_key(spark, tmp_path):
    path = str(tmp_path / "store")
    index = store_of(spark, path, [range(i * 1000, i * 1000 + 1000) for i in range(10, 16)])
    assert len(index.files()) == 12
    # Files that are not indexed are always read.
    assert len(index.candidates(ids_of(spark, [99]))) == 12
    assert index.update() == 12 and index.update() == 0
    assert index.candidates(ids_of(spark, [99])) == []
    assert len(index.candidates(ids_of(spark, [12_345, 12_347]))) == 1
    assert len(index.candidates(ids_of(spark, [12_344, 14_001]))) == 2
    # Inside the range of a file but not in it: the filter knows most of them.
    absent = spark.createDataFrame([("1:12345x", 1)], "_id string, partition int")
    assert index.candidates(absent) == []
    for probed in (0, 10_000):
        index.probed = probed
        ids = ids_of(spark, [10_000, 15_999, 7, 13_333])
        known = {r._id for r in index.known(ids).collect()}
        assert {"0:10000", "1:15999", "1:13333"} <= known and len(known) < 200
    assert index.known(ids_of(spark, [])).count() == 0
    # Readers of the store do not see the index.
    assert spark.read.parquet(path).count() == 6000 and set(spark.read.parquet(path).columns) == {"_id", "partition"}


def test_filters_lose_no_key(spark, tmp_path):
    random.seed(2)
    keys = random.sample(range(10**9), 3000)
    index = store_of(spark, str(tmp_path / "store"), [keys])
    index.update()
    assert {r._id for r in index.known(ids_of(spark, keys)).collect()} == {f"{i % 2}:{i}" for i in keys}
    others = ids_of(spark, random.sample(range(10**9, 2 * 10**9), 3000))
    assert index.known(others).count() < 300
    filled = index.entries().select(F.size("filter").alias("n"), "keys").collect()
    assert all(r.n & (r.n - 1) == 0 and 10 * r["keys"] <= 64 * r.n <= 20 * r["keys"] for r in filled)


def test_second_dump_reads_few_stored_files(spark, tmp_path):
    steps, store = make_steps(spark), str(tmp_path / "store")

    def dump(name, ids):
        path = tmp_path / name
        path.write_text("\n".join(["header", *[line(str(100000000000000 + i), f"good {i}", "Middle Park") for i in ids], "footer"]))
        return str(path)

    assert ingest_job(spark, dump("1.json", range(400)), store, steps).count() == 0
    assert ingest_job(spark, dump("2.json", range(1000, 1400)), store, steps).count() == 0
    files = len(KeyIndex(spark, store).files())
    conflicts = ingest_job(spark, dump("3.json", [1001, 1001, 5000, 5000, 5000, 6000]), store, steps)
    assert sorted(r.rejected for r in conflicts.collect()) == [2, 2]
    stored = spark.read.parquet(store)
    assert stored.count() == 802 == stored.select("_id").distinct().count()
    index = KeyIndex(spark, store)
    ids = stored.where(F.col("tid") == "100000000001001").select("_id", "partition")
    assert len(index.candidates(ids)) < files
    # The stored keys are cut down by the batch's own filter before anything is shuffled.
    plan = index.known(ids)._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan.lower() and "ReadSchema: struct<_id:string>" in plan


def test_pages_and_marks_from_ranges(spark, tmp_path):
    random.seed(3)
    path, keys = str(tmp_path / "store"), random.sample(range(10_000), 900)
    for i in range(0, 900, 90):
        # Files overlap a little.
        part = sorted(keys)[i : i + 90] if i % 180 else sorted(keys)[i : i + 90] + [20_000 + i]
        rows = [(k, f"t{k}", "s" if k % 3 else "a/b =c%é") for k in part]
        spark.createDataFrame(rows, "tid long, text string, server string").coalesce(1).write.mode("append").partitionBy("server").parquet(path)
    index = KeyIndex(spark, path, "tid", "server", "tid BIGINT, server STRING")
    for indexed in (False, True):
        if indexed:
            assert index.update() == 20
        every = sorted(r.tid for r in spark.read.parquet(path).collect())
        for cursor in (None, -5, every[0], every[450], every[-1], 10**9):
            for n in (1, 37, 400, 5000):
                above = [k for k in every if cursor is None or k > cursor][:n]
                below = [k for k in every[::-1] if cursor is None or k < cursor][:n]
                if n in (37, 5000):
                    assert [r.tid for r in index.page_after(cursor, n).collect()] == above
                    assert [r.tid for r in index.page_before(cursor, n).collect()] == below
                assert len(index.page_files(cursor, n)) <= 20
        want = {s: max(k for k in every if (k % 3 == 0) == (s != "s")) for s in ("s", "a/b =c%é")}
        assert {r.bucket: r.mark for r in index.marks().collect()} == want
    assert len(index.page_files(every[450], 5)) <= 14 and len(index.page_files(None, 5)) <= 12
    assert set(index.page_after(every[3], 5).columns) == {"tid", "text", "server"}
    # Files that came since are read as well.
    spark.createDataFrame([(5, "late", "u")], "tid long, text string, server string").write.mode("append").partitionBy("server").parquet(path)
    assert {r.bucket: r.mark for r in index.marks().collect()} == want | {"u": 5} and index.page_after(4, 1).first().text in ("late", "t5")


def test_bulk_insert_shuffles_keys_only(spark):
    base = spark.createDataFrame([(f"k{i}", "old", 1) for i in range(50)], "_id string, text string, version long")
    rows = [(f"k{i}", f"text {i}", i) for i in range(40, 60)] + [("k55", "second", 0), ("k58", "second", 99), ("k41", "x", 1)]
    new = spark.createDataFrame(rows, "_id string, text string, at int")
    inserted, conflicts = docstore.bulk_insert(base, new, "at")
    got = {r._id: (r.text, r.version) for r in inserted.collect()}
    assert got == {f"k{i}": (f"text {i}", 1) for i in range(50, 60)} | {"k55": ("second", 1)}
    assert {r._id: r.rejected for r in conflicts.collect()} == {f"k{i}": 1 for i in range(40, 50)} | {"k41": 2, "k55": 1, "k58": 1}


# --- feature collections -------------------------------------------------------------------------


def feature(i, rnd):
    name = rnd.choice(["plain", "bra{ce", "clo}se", 'quo"te', "back\\slash\\", '\\"}{', "é日", "", "}" * 5, '{"a": "}"}'])
    point = {"type": "Point", "coordinates": [i, -i]}
    shape = rnd.choice([None, point, {"type": "GeometryCollection", "geometries": [point, {"type": "GeometryCollection", "geometries": [point]}]}])
    parts = [("type", "Feature"), ("properties", {"code": i, "name": name, "state": rnd.choice([None, "V{", "N"]), "more": {"a": {"b": i}}}), ("geometry", shape)]
    rnd.shuffle(parts)
    return dict(parts), (str(i), name, dict(parts)["properties"]["state"], shape)


def write_collection(path, rnd, first, n, indent):
    made = [feature(i, rnd) for i in range(first, first + n)]
    crs = ("crs", {"type": "name", "properties": {"name": "x}"}})
    members = [("type", "FeatureCollection"), crs, ("features", [f for f, _ in made])]
    rnd.shuffle(members)
    path.write_text(json.dumps(dict(members), indent=indent, ensure_ascii=rnd.random() < 0.5) + rnd.choice(["", "\n", " \n\n"]))
    return [row for _, row in made]


@pytest.mark.parametrize("indent, split", [(None, "1k"), (2, "1k"), (None, "128m")])
def test_features_of_split_files(spark, tmp_path, indent, split):
    rnd, want = random.Random(7), []
    folder = tmp_path / "regions"
    folder.mkdir()
    for i, n in enumerate([150, 1, 0, 80]):
        want += write_collection(folder / f"{i}.geojson", rnd, 1000 * i, n, indent)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        assert (spark.read.option("lineSep", "}").text(str(folder)).rdd.getNumPartitions() > 8) == (split == "1k")
        found = tables.read_regions(spark, str(folder), "code", "name", "state", "geometry", format="geojson").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    got = [(r.code, r.name, r.state, r.geometry and json.loads(r.geometry)) for r in found]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_bad_features_end_the_job_or_are_set_apart(spark, tmp_path):
    path = tmp_path / "bad.geojson"
    path.write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"code":"1"},"geometry":null},{"type":"Feature","properties":{code},"geometry":null}]}')
    with pytest.raises(Exception):
        geojson.read_features(spark, str(path)).collect()
    good, rejected = geojson.read_features(spark, str(path), mode="PERMISSIVE")
    assert [r.properties for r in good.collect()] == [{"code": "1"}] and "{code}" in rejected.first().rejected
    none = tmp_path / "none.geojson"
    none.write_text('{"type":"FeatureCollection","features":[]}')
    found = tables.read_regions(spark, str(none), "a", "b", "c", format="geojson")
    assert found.columns == ["code", "name", "state"] and found.count() == 0


# --- array files ---------------------------------------------------------------------------------


def test_arrays_are_whole_after_a_forced_restart(spark, tmp_path, monkeypatch):
    arrived, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    rows = [{"id": i, "text": f'"{i}" [é]'} for i in range(60)]
    for i in range(3):
        drop(arrived, f"{i}.json", rows[i::3])

    def run():
        stream = spark.readStream.schema("id INT, text STRING").option("maxFilesPerTrigger", 1).json(str(arrived))
        array_sink.array_stream(stream, out, marks).awaitTermination()

    # The second batch has moved its files when it is ended, and is not committed.
    plain, calls = Folder.write, []

    def write(self, name, text):
        calls.append(name)
        if len(calls) == 2:
            raise OSError("ended here")
        plain(self, name, text)

    monkeypatch.setattr(Folder, "write", write)
    with pytest.raises(Exception):
        run()
    arrays = array_sink.JsonArrays(spark, out)
    assert arrays.committed() == [0] and arrays.read("id INT, text STRING").count() == 20
    run()
    assert arrays.committed() == [0, 1, 2]
    files = glob.glob(f"{out}/*.json")
    assert sorted(files) == sorted(f.removeprefix("file:") for f in arrays.files())
    assert sorted((r["id"], r["text"]) for f in files for r in json.load(open(f))) == [(r["id"], r["text"]) for r in rows]
    # The last batch once more, as after a crash between the sink's commit and the stream's.
    arrays.append(spark.createDataFrame([(1, "again")], "id INT, text STRING"), 2)
    assert arrays.read("id INT, text STRING").count() == 60
    assert array_sink.JsonArrays(spark, str(tmp_path / "none")).read("id INT").count() == 0


# --- correlations --------------------------------------------------------------------------------


def test_correlations_equal_pandas_pair_by_pair(spark):
    random.seed(5)
    value = lambda: random.choice([None, random.random()])
    frame = pd.DataFrame([[value() for _ in range(5)] + [None] for _ in range(80)], columns=["a", "b", "c.d", "e", "f", "none"], dtype=float)
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in frame.itertuples(index=False)], "a double, b double, `c.d` double, e double, f double, none double")
    xs, ys = ["a", "c.d"], ["b", "e", "f", "none"]
    before = jobs(spark)
    got = {(r.x, r.y): (r.correlation, r.areas) for r in official.correlations(df, xs, ys).collect()}
    assert jobs(spark) - before <= 3 and len(got) == 8
    for (x, y), (c, n) in got.items():
        both = frame[[x, y]].dropna()
        assert n == len(both)
        assert c is None if not n else abs(c - both[x].corr(both[y])) < 1e-9
    empty = official.correlations(df.limit(0), ["a"], ["b"]).collect()
    assert [(r.x, r.y, r.correlation, r.areas) for r in empty] == [("a", "b", None, 0)]
