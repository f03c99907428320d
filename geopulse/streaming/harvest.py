"""Incremental harvest of statuses from several servers."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.constants import PAGE_SIZE
from geopulse.functions.scalars import iso_utc, score_bin
from geopulse.functions.text import html_to_text, join_tags
from geopulse.operators.keyindex import KeyIndex
from geopulse.operators.paging import next_pages
from geopulse.plans.jobs import Enrichers
from geopulse.schemas import STATUS, TOOT
from geopulse.session import checkpointed
from geopulse.sources.paged import PAGE_ROWS, paged_statuses


def harvest_stream(spark: SparkSession, path, files_per_trigger=None) -> DataFrame:
    """Stream of statuses that arrive as JSON files; the checkpoint remembers what was read.

    All servers share the stream, told apart by the ``server`` column. An empty file is no data.
    """
    reader = spark.readStream.schema(STATUS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def server_streams(spark: SparkSession, paths: dict[str, str], files_per_trigger=None) -> DataFrame:
    """One folder per server, read as one stream."""
    streams = [
        harvest_stream(spark, path, files_per_trigger).withColumn("server", F.lit(server))
        for server, path in paths.items()
    ]
    out = streams[0]
    for stream in streams[1:]:
        out = out.unionByName(stream)
    return out


def enrich_toots(df: DataFrame, enrichers: Enrichers) -> DataFrame:
    """Statuses in stored form. Works on streams and on tables alike."""
    key = ["server", "id"]
    text = df.withColumn("_text", html_to_text("content"))
    named = enrichers.normaliser(text, "_text", key, "content")
    scored = enrichers.scorer(named, "content", key, "_compound")
    return scored.select(
        "server",
        F.col("id").alias("tid"),
        iso_utc("created_at").alias("date"),
        F.col("account.id").cast("string").alias("author"),
        F.col("language").alias("lang"),
        "content",
        score_bin("_compound").alias("score"),
        join_tags("tags").alias("tags"),
    )


def insert_new(store_path, key=("server", "tid")):
    """Micro-batch sink that stores each ``(server, tid)`` once, also when a batch is replayed.

    The batch is small against the store: the store's key index says which files may hold one of its
    keys, and only these are read.
    """
    server, tid = key

    def insert(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        index = KeyIndex(spark, store_path, tid, server, f"{tid} BIGINT, {server} STRING")
        batch = batch.persist()
        try:
            keys = batch.select(*key).distinct()
            if keys.isEmpty():
                return
            near = index.known(keys)
            # Of copies in one batch the first by date and then by its fields stays.
            rest = [c for c in batch.columns if c not in key]
            first = F.min_by(F.struct(*rest), F.struct("date", *rest)).alias("_first")
            fresh = batch.groupBy(*key).agg(first).select(*key, "_first.*").join(near, list(key), "left_anti")
            fresh.write.mode("append").partitionBy(server).parquet(store_path)
            index.update()
        finally:
            batch.unpersist()

    return insert


def compact_store(spark: SparkSession, store_path, out, file_rows=1_000_000):
    """A copy of the store in few files: batches leave one for each server and task.

    Readers and the harvest go on with the old path until they are pointed at the new one.
    """
    rows = spark.read.schema(TOOT).parquet(store_path)
    # A file's worth of ids of a server is one task's work, however many a server has.
    part = F.floor(F.col("tid") / file_rows)
    rows.repartition("server", part).write.option("maxRecordsPerFile", file_rows).partitionBy("server").parquet(out)


def ensure_store(spark: SparkSession, store_path):
    """An empty store, so that the first batch can look for stored keys."""
    spark.createDataFrame([], TOOT).write.mode("ignore").partitionBy("server").parquet(store_path)


def run_harvest(spark, statuses: DataFrame, enrichers, store_path, checkpoint, trigger=None):
    """Start the harvest query. The default trigger takes what is there and stops.

    Statuses are enriched batch by batch, so models too large for a lookup can be joined as well.
    """
    ensure_store(spark, store_path)
    insert = insert_new(store_path)

    def store(batch: DataFrame, batch_id: int):
        insert(enrich_toots(batch, enrichers), batch_id)

    return (
        statuses.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def harvest_pass(source: DataFrame, enrichers, store_path, n=PAGE_SIZE) -> int:
    """One pass of the polling harvest over a status table: next page per server, enrich, store.

    Returns how many statuses came; 0 when there was nothing new. Rows at or below the greatest
    stored id of their server are never asked for again.
    """
    spark = source.sparkSession
    ensure_store(spark, store_path)
    stored = spark.read.schema(TOOT).parquet(store_path).select("server", F.col("tid").alias("id"))
    # A page per server: small, and needed twice.
    page = checkpointed(enrich_toots(next_pages(source, stored, n, by="id"), enrichers))
    came = page.count()
    if came:
        insert_new(store_path)(page, 0)
    return came


def drain(query) -> None:
    """Let a running stream take all there is, batch after batch until nothing is new, and stop it."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def harvest_pages(spark: SparkSession, path, enrichers, store_path, checkpoint, page=PAGE_ROWS) -> None:
    """The polling harvest: page after page of every server, until no server has anything new.

    The stream's checkpoint remembers how far each server was read, so the next call asks for what is
    newer only, and a call that was ended goes on with the batch it was at.
    """
    pages = paged_statuses(spark, path, page)
    drain(run_harvest(spark, pages, enrichers, store_path, checkpoint, {"processingTime": "0 seconds"}))


def append_stream(df: DataFrame, path, checkpoint, trigger=None):
    """Append every arriving row as a JSON line."""
    return (
        df.writeStream.format("json")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
