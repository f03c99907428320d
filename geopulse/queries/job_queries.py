"""End-to-end jobs and streams, run on data derived from the given tables."""

from pyspark.sql import functions as F

from geopulse.constants import PAGE_SIZE
from geopulse.functions.scalars import score_bin
from geopulse.operators.gazetteer import build_gazetteer
from geopulse.operators.language import train_lang
from geopulse.operators.sentiment import polarity
from geopulse.plans.jobs import Enrichers, ingest_job, ingest_posts
from geopulse.queries.place_queries import SQL_GAZETTEER, SQL_PLACES, places, sql_resolved
from geopulse.queries.registry import (
    SQL_LEMMAS, SQL_LEXICON, SQL_POSTS, SQL_PROFILES, TOPIC_WORDS, lemmas, lexicon, query, sql_bin,
    sql_compound, sql_content, sql_detect, sql_mentions, sql_place, sql_strip,
)
from geopulse.queries.source_queries import SQL_LINE_FIELDS, post_lines
from geopulse.queries.text_queries import (
    SQL_LARGE_LEMMAS, SQL_LARGE_LEXICON, large_lemmas, large_lexicon, sql_page_text,
)
from geopulse.queries.view_queries import STATS
from geopulse.session import scratch_path
from geopulse.sources import paged
from geopulse.streaming import array_sink, harvest, live_view


def enrichers(t):
    """All steps of an ingest."""
    profiles = train_lang(t.documents, "text", "lang")
    return Enrichers.from_tables(
        lemmas(t.spark), lexicon(t.spark), profiles, build_gazetteer(places(t))
    )


def toot_enrichers(t):
    """Statuses name their language and have no place."""
    return Enrichers.from_tables(lemmas(t.spark), lexicon(t.spark))


def sql_ingest(extra):
    return f"""WITH {SQL_LEMMAS}, {SQL_LEXICON}, {SQL_PROFILES}, {SQL_PLACES}, {SQL_GAZETTEER}, {SQL_LINE_FIELDS},
    kept AS (SELECT tid, author, date, location, tags, {sql_strip('text')} AS text,
                    {sql_place('lower(location)')} AS place
             FROM fields WHERE length(tid) >= 15 AND text IS NOT NULL AND author <> '' AND date <> ''),
    {sql_content('kept', 'tid', 'text')},
    {sql_detect('content', 'tid', 'content')},
    {sql_compound('content', 'tid')},
    located AS (SELECT * FROM kept WHERE place IS NOT NULL),
    {sql_resolved('located')}
    SELECT (('0x' || substr(md5(k.tid), 1, 8))::BIGINT % 4) || ':' || k.tid AS _id, k.tid AS tid, author, date,
    x.lang AS lang, c.content AS content, location, r.sal AS sal, {sql_bin('compound')} AS score, tags
    FROM kept k JOIN content c ON k.tid = c.tid JOIN polar p ON k.tid = p.tid
    LEFT JOIN detected x ON k.tid = x.tid LEFT JOIN resolved r ON k.place = r.place
    WHERE c.content <> '' {extra}"""


@query("ingest_posts", sql_ingest(""))
def ingest_all(t):
    return ingest_posts(post_lines(t), enrichers(t))


@query("ingest_geo_posts", sql_ingest("AND location IS NOT NULL AND r.sal <> ''"))
def ingest_geo(t):
    """The stored form: written in batches by id partition, and read back."""
    raw, store = scratch_path(t.spark, "raw"), scratch_path(t.spark, "store")
    post_lines(t).write.text(raw)
    ingest_job(t.spark, raw, store, enrichers(t), geo_only=True)
    return t.spark.read.parquet(store).drop("partition")


@query("ingest_posts_joined", sql_ingest("").replace(SQL_LEMMAS, SQL_LARGE_LEMMAS).replace(SQL_LEXICON, SQL_LARGE_LEXICON))
def ingest_posts_joined(t):
    """All models too large for a lookup: every step joins, and the dump is read once."""
    profiles = train_lang(t.documents, "text", "lang")
    steps = Enrichers.from_tables(large_lemmas(t), large_lexicon(t), profiles, build_gazetteer(places(t)), max_rows=0)
    return ingest_posts(post_lines(t), steps)


@query("ingest_twice", sql_ingest(""))
def ingest_twice(t):
    """A dump with repeated lines, and a second one that overlaps: each post is stored once."""
    store, steps = scratch_path(t.spark, "store"), enrichers(t)
    lines = post_lines(t)
    half = F.pmod(F.crc32("value"), F.lit(2)) == 0
    for dump in (lines.where(half).unionByName(lines.where(half)), lines):
        raw = scratch_path(t.spark, "raw")
        dump.write.text(raw)
        ingest_job(t.spark, raw, store, steps)
    return t.spark.read.parquet(store).drop("partition")


def statuses(t):
    """Conversation turns as statuses; the role stands for the server."""
    return t.conversations.selectExpr(
        "role AS server", "conv_id * 1000 + turn AS id", "TIMESTAMP '2023-05-01 00:00:00' AS created_at",
        "'en' AS language", "concat('<p>', text, '</p><p>Q&amp;A</p><p>&#9999999;&#0000065;&notit;</p>') AS content",
        "named_struct('id', conv_id) AS account", "array('a', role) AS tags",
    )


SQL_TOOTS = f"""{SQL_LEMMAS}, {SQL_LEXICON},
    st AS (SELECT role AS server, conv_id * 1000 + turn AS tid, conv_id,
                  role || '/' || (conv_id * 1000 + turn) AS k,
                  {sql_page_text("'<p>' || text || '</p><p>Q&amp;A</p>'")} || chr(65533) || 'A¬it;' AS text FROM conversations),
    {sql_content('st', 'k', 'text')},
    {sql_compound('content', 'k')},
    toots AS (SELECT server, tid, '2023-05-01T00:00:00.000Z' AS date, CAST(conv_id AS VARCHAR) AS author, 'en' AS lang,
              content, {sql_bin('compound')} AS score, 'a|' || server AS tags
              FROM st JOIN content c ON st.k = c.k JOIN polar p ON st.k = p.k)"""


@query("enrich_toots", f"WITH {SQL_TOOTS} SELECT * FROM toots")
def enrich_toots(t):
    return harvest.enrich_toots(statuses(t), toot_enrichers(t))


@query("stream_harvest", f"WITH {SQL_TOOTS} SELECT * FROM toots")
def stream_harvest(t):
    """Statuses arrive as files; the second run over replayed files must add nothing."""
    arrived, store = scratch_path(t.spark, "statuses"), scratch_path(t.spark, "toots")
    statuses(t).write.json(arrived)
    steps = toot_enrichers(t)
    for run in range(2):
        # A fresh checkpoint makes the second run read every file again.
        stream = harvest.harvest_stream(t.spark, arrived)
        marks = scratch_path(t.spark, "marks")
        harvest.run_harvest(t.spark, stream, steps, store, marks).awaitTermination()
    return t.spark.read.parquet(store)


@query("stream_paged_harvest", f"WITH {SQL_TOOTS} SELECT * FROM toots")
def stream_paged_harvest(t):
    """Pages of every server until nothing is new, and again from the checkpoint when newer statuses came."""
    pages, store, marks = (scratch_path(t.spark, n) for n in ("pages", "toots", "marks"))
    steps, all_statuses = toot_enrichers(t), statuses(t)
    newest = all_statuses.agg(F.max("id")).first()[0] or 0
    for part in (F.col("id") <= newest // 2, F.col("id") > newest // 2):
        paged.write_pages(all_statuses.where(part), pages)
        harvest.harvest_pages(t.spark, pages, steps, store, marks, page=10_000)
    return t.spark.read.parquet(store)


@query(
    "harvest_pass",
    f"""WITH {SQL_TOOTS}, r AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY tid) AS rk FROM toots)
    SELECT * EXCLUDE (rk) FROM r WHERE rk <= 2 * {PAGE_SIZE}""",
)
def harvest_pass(t):
    """Two passes of the polling harvest: each stores the next page of every server."""
    store, steps = scratch_path(t.spark, "polled"), toot_enrichers(t)
    for _ in range(2):
        harvest.harvest_pass(statuses(t), steps, store)
    return t.spark.read.parquet(store)


@query(
    "stream_servers_append",
    "SELECT role AS server, conv_id * 1000 + turn AS id, conv_id AS account FROM conversations",
)
def stream_servers_append(t):
    """One folder per server, read as one stream and appended as JSON."""
    roles = ["system", "user", "assistant"]
    paths = {}
    for role in roles:
        paths[role] = scratch_path(t.spark, f"server-{role}")
        statuses(t).where(F.col("server") == role).drop("server").write.json(paths[role])
    out = scratch_path(t.spark, "appended")
    stream = harvest.server_streams(t.spark, paths, files_per_trigger=4)
    rows = stream.select("server", "id", F.col("account.id").alias("account"))
    harvest.append_stream(rows, out, scratch_path(t.spark, "marks")).awaitTermination()
    return t.spark.read.schema("server STRING, id BIGINT, account BIGINT").json(out)


@query("stream_json_array", "SELECT role AS server, conv_id * 1000 + turn AS id, text AS content FROM conversations")
def stream_json_array(t):
    """Statuses appended as JSON arrays; the stream is ended after a batch and started again."""
    arrived, out, marks = (scratch_path(t.spark, n) for n in ("statuses", "arrays", "marks"))
    rows = t.conversations.selectExpr("role AS server", "conv_id * 1000 + turn AS id", "text AS content")
    schema = "server STRING, id BIGINT, content STRING"
    for part in (F.col("id") % 2 == 0, F.col("id") % 2 == 1):
        rows.where(part).write.mode("append").json(arrived)
        stream = t.spark.readStream.schema(schema).json(arrived)
        array_sink.array_stream(stream, out, marks).awaitTermination()
    return array_sink.JsonArrays(t.spark, out).read(schema)


@query(
    "stream_view",
    f"""WITH p AS ({SQL_POSTS}) SELECT sal, {STATS} FROM p
    WHERE {sql_mentions('content', TOPIC_WORDS['income'])} GROUP BY sal""",
)
def stream_view(t):
    """The topic view kept current while posts arrive file by file."""
    arrived, out = scratch_path(t.spark, "posts"), scratch_path(t.spark, "view")
    # Three batches, of files whose size does not grow with the posts.
    posts = t.posts
    files = max(1, -(-posts.rdd.getNumPartitions() // 3))
    posts.repartition(3 * files).write.json(arrived)
    schema = "tid STRING, sal STRING, content STRING, lang STRING, score INT"
    stream = t.spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(arrived)
    view = live_view.live_view(stream, "income", words=TOPIC_WORDS["income"])
    live_view.run_live_view(view, out, scratch_path(t.spark, "marks")).awaitTermination()
    return live_view.read_live_view(t.spark, out)


@query(
    "plugged_enrichers",
    f"""WITH {SQL_LEXICON}, l AS (SELECT doc_id, text || ' and the' AS content FROM documents),
    {sql_compound('l', 'doc_id')}
    SELECT l.doc_id AS doc_id, CAST(length(content) AS INTEGER) AS size, 'xx' AS lang, {sql_bin('compound')} AS score
    FROM l JOIN polar ON l.doc_id = polar.doc_id""",
)
def plugged_enrichers(t):
    """The three steps are exchangeable: any function that adds the column will do."""
    from geopulse.plans.jobs import enrich

    def extend(df, text, key, out):
        return df.withColumn(out, F.concat(text, F.lit(" and the")))

    def unknown(df, text, key, out):
        return df.withColumn(out, F.lit("xx"))

    words = lexicon(t.spark)
    steps = Enrichers(extend, unknown, lambda df, text, key, out: polarity(df, text, words, key, out))
    done = enrich(t.documents.drop("lang"), steps, "text", ["doc_id"])
    return done.select("doc_id", F.length("content").alias("size"), "lang", "score")
