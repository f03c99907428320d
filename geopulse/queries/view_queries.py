"""Views over posts and region tables."""

from pyspark.sql import functions as F

from geopulse.constants import SERVERS
from geopulse.operators import states, views
from geopulse.operators.filters import drop_all_null, in_state, ready_for_join
from geopulse.operators.regions import metric_layers, region_metrics
from geopulse.plans.jobs import scenario_job, score_distributions, topic_columns, topic_map_job, topic_region_table
from geopulse.queries.registry import (
    SQL_AREAS, SQL_LEXICON, SQL_POSTS, TOPIC_WORDS, lexicon, query, sql_bin, sql_compound,
    sql_mentions, sql_round, sql_strip,
)
from geopulse.functions.scalars import score_bin
from geopulse.functions.text import strip_social
from geopulse.operators.sentiment import polarity
from geopulse.session import scratch_path

STATS = (
    "CAST(sum(score) AS BIGINT) AS \"sum\", count(score) AS \"count\", min(score) AS \"min\", "
    "max(score) AS \"max\", CAST(sum(score * score) AS BIGINT) AS sumsqr"
)


def sql_topic_views(posts, by, topics=TOPIC_WORDS):
    """SELECT of count and average score of each topic per ``by``."""
    cols = []
    for name, words in topics.items():
        test = sql_mentions("content", words) if words else "TRUE"
        n = f"nullif(count(CASE WHEN {test} THEN 1 END), 0)"
        cols.append(f'{n} AS "count {name}"')
        cols.append(
            sql_round(f"CAST(sum(CASE WHEN {test} THEN score END) AS DOUBLE) / {n}")
            + f' AS "average_sentiment({name})"'
        )
    return f"SELECT {by}, {', '.join(cols)} FROM {posts} GROUP BY {by}"


def area_posts(posts):
    """Region codes of nations in place of source names."""
    return posts.withColumn("sal", F.substring("sal", 4, 10))


SQL_AREA_POSTS = (
    "SELECT tid, substr(sal, 4) AS sal, content, lang, score FROM (" + SQL_POSTS + ")"
)
COLUMNS = ", ".join(f'"{c}"' for c in topic_columns())


@query(
    "topic_region_sentiment",
    f"""WITH {SQL_LEXICON}, areas AS ({SQL_AREAS}),
    st AS (SELECT doc_id, substr(source, 4) AS sal, {sql_strip('text')} AS content FROM documents),
    {sql_compound('st', 'doc_id')},
    posts AS (SELECT sal, content, {sql_bin('compound')} AS score FROM st JOIN polar ON st.doc_id = polar.doc_id),
    m AS ({sql_topic_views('posts', 'sal')})
    SELECT code, name, state, {COLUMNS} FROM areas LEFT JOIN m ON code = sal
    WHERE coalesce({COLUMNS}) IS NOT NULL""",
)
def topic_region_sentiment(t):
    """Flagship: strip, score, flag topics, aggregate per region, join onto the regions."""
    posts = t.documents.select(
        "doc_id", F.substring("source", 4, 10).alias("sal"), strip_social("text").alias("content")
    )
    scored = polarity(posts, "content", lexicon(t.spark), ["doc_id"])
    scored = scored.withColumn("score", score_bin("compound"))
    metrics = views.topic_views(scored, TOPIC_WORDS).withColumnRenamed("sal", "code")
    return drop_all_null(region_metrics(t.areas, {"posts": metrics}, "code"), topic_columns())


@query(
    "topic_view_level1",
    f"""WITH p AS ({SQL_POSTS}) SELECT sal, {STATS} FROM p
    WHERE {sql_mentions('content', TOPIC_WORDS['income'])} GROUP BY sal""",
)
def topic_view_level1(t):
    return views.topic_view(t.posts, "income", words=TOPIC_WORDS["income"])


@query(
    "topic_view_raw",
    f"""WITH p AS ({SQL_POSTS}) SELECT sal, content, tid, score FROM p
    WHERE {sql_mentions('content', TOPIC_WORDS['crime'])}""",
)
def topic_view_raw(t):
    words = TOPIC_WORDS["crime"]
    posts = t.posts.where(views.mentions("content", words))
    return views.view(posts, ["sal", "content", "tid"], reducer=None)


@query(
    "view_grand_total",
    f"WITH p AS ({SQL_POSTS}) SELECT {STATS} FROM p",
)
def view_grand_total(t):
    return views.view(t.posts, ["sal", "lang"], level=0)


@query(
    "view_levels",
    f"""WITH p AS ({SQL_POSTS})
    SELECT 0 AS level, NULL AS sal, NULL AS lang, NULL AS tid, {STATS} FROM p
    UNION ALL SELECT 1, sal, NULL, NULL, {STATS} FROM p GROUP BY sal
    UNION ALL SELECT 2, sal, lang, NULL, {STATS} FROM p GROUP BY sal, lang
    UNION ALL SELECT 3, sal, lang, tid, {STATS} FROM p GROUP BY sal, lang, tid""",
)
def view_levels(t):
    return views.view_levels(t.posts, ["sal", "lang", "tid"])


@query(
    "view_from_states",
    f"""WITH p AS ({SQL_POSTS})
    SELECT 0 AS level, NULL AS lang, NULL AS sal, {STATS} FROM p
    UNION ALL SELECT 1, lang, NULL, {STATS} FROM p GROUP BY lang
    UNION ALL SELECT 2, lang, sal, {STATS} FROM p GROUP BY lang, sal""",
)
def view_from_states(t):
    """All levels from states of two batches, the second stored twice."""
    store = states.StateStore(t.spark, scratch_path(t.spark, "states"), ["lang", "sal"], "score")
    odd = F.pmod(F.crc32("tid"), F.lit(2)) == 1
    for batch, rows in ((0, t.posts.where(odd)), (1, t.posts.where(~odd)), (1, t.posts.where(~odd))):
        store.add(rows, batch)
    return store.compact(scratch_path(t.spark, "states")).levels()


@query(
    "view_user_reducer",
    f"""WITH p AS ({SQL_POSTS}) SELECT lang, round(avg(score), 9) AS mean, round(stddev_samp(score), 9) AS std FROM p GROUP BY lang""",
)
def view_user_reducer(t):
    """Mean and deviation of a coarser level, from states at the finest."""
    fine = states.states_of(t.posts, ["lang", "sal"], "score", states.MEAN)
    out = states.finished(states.merged(fine, ["lang"], states.MEAN), states.MEAN)
    return out.select("lang", F.round("mean", 9).alias("mean"), F.round("std", 9).alias("std"))


@query(
    "view_ordered",
    f"WITH p AS ({SQL_POSTS}) SELECT sal, lang, CAST(sum(score) AS BIGINT) AS \"sum\" FROM p GROUP BY sal, lang",
)
def view_ordered(t):
    return views.view(t.posts, ["sal", "lang"], level=2, reducer="sum", ordered=True)


@query(
    "topic_split",
    f"""WITH p AS ({SQL_POSTS}) SELECT CASE WHEN {sql_mentions('content', TOPIC_WORDS['crime'])}
    THEN 'CrimeMentioned' ELSE 'CrimeAbsent' END AS title, sal, {STATS} FROM p GROUP BY 1, 2""",
)
def topic_split(t):
    return views.topic_split(t.posts, "crime", words=TOPIC_WORDS["crime"])


@query(
    "topic_views",
    f"WITH p AS ({SQL_POSTS}) {sql_topic_views('p', 'sal')}",
)
def topic_views(t):
    return views.topic_views(t.posts, TOPIC_WORDS)


@query(
    "average_sentiment",
    f"""WITH p AS ({SQL_POSTS}) SELECT lang, {sql_round('CAST(sum(score) AS DOUBLE) / count(*)')} AS average
    FROM p GROUP BY lang""",
)
def average_sentiment(t):
    return views.view(t.posts, ["lang"]).select("lang", views.average_sentiment().alias("average"))


@query(
    "map_view",
    f"""WITH e AS (SELECT lang || '/' || sal AS key, score AS value FROM ({SQL_POSTS})
        UNION ALL SELECT lang || '/' || 'all', score FROM ({SQL_POSTS}))
    SELECT key, CAST(sum(value) AS BIGINT) AS "sum", count(*) AS "count", min(value) AS "min",
    max(value) AS "max", CAST(sum(value * value) AS BIGINT) AS sumsqr FROM e GROUP BY key""",
)
def map_view(t):
    def emit(posts):
        rows = F.array(
            F.struct(F.array("lang", "sal").alias("key"), F.col("score").alias("value")),
            F.struct(F.array("lang", F.lit("all")).alias("key"), F.col("score").alias("value")),
        )
        return posts.select(F.inline(rows))

    out = views.map_view(t.posts, emit, "stats", level=2)
    return out.withColumn("key", F.array_join("key", "/"))


@query(
    "reducers",
    f"""WITH p AS ({SQL_POSTS}) SELECT s.lang, s."sum", c."count" FROM
    (SELECT lang, CAST(sum(score) AS BIGINT) AS "sum" FROM p GROUP BY lang) s JOIN
    (SELECT lang, count(*) AS "count" FROM p GROUP BY lang) c ON s.lang = c.lang""",
)
def reducers(t):
    sums = views.view(t.posts, ["lang"], reducer="sum")
    return sums.join(views.view(t.posts, ["lang"], reducer="count"), "lang")


@query(
    "hierarchy",
    """WITH b AS (SELECT CAST(user_id AS VARCHAR) AS u, event_type AS e FROM events)
    SELECT u AS id, u AS label, '' AS parent, count(*) AS value, 1 AS depth FROM b GROUP BY u
    UNION ALL SELECT u || '/' || e, e, u, count(*), 2 FROM b GROUP BY u, e""",
)
def hierarchy(t):
    return views.hierarchy(t.events, ["user_id", "event_type"])


@query(
    "region_left_joins",
    f"""WITH a AS ({SQL_AREAS}),
    c AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, count(*) AS customers FROM customer
          GROUP BY c_nationkey),
    s AS (SELECT CAST(s_nationkey AS VARCHAR) AS code, count(*) AS suppliers FROM supplier
          GROUP BY s_nationkey)
    SELECT a.code, name, state, customers, suppliers FROM a LEFT JOIN c ON a.code = c.code
    LEFT JOIN s ON a.code = s.code WHERE state = 'ASIA' AND (customers IS NOT NULL OR suppliers IS NOT NULL)""",
)
def region_left_joins(t):
    customers = t.customer.groupBy(
        F.col("c_nationkey").alias("code")
    ).agg(F.count("*").alias("customers"))
    suppliers = t.supplier.groupBy(
        F.col("s_nationkey").alias("code")
    ).agg(F.count("*").alias("suppliers"))
    joined = region_metrics(
        in_state(t.areas, "ASIA", "state"), {"customers": customers, "suppliers": suppliers}, "code"
    )
    return drop_all_null(joined, ["customers", "suppliers"])


@query(
    "ready_for_join",
    f"""WITH p AS ({SQL_POSTS}), f AS (SELECT * FROM p WHERE {sql_mentions('content', TOPIC_WORDS['income'])})
    SELECT sal AS code, count(*) AS "count income",
    {sql_round('CAST(sum(score) AS DOUBLE) / count(*)')} AS "average_sentiment(income)" FROM f GROUP BY sal""",
)
def ready_for_join_query(t):
    served = views.topic_view(t.posts, "income", words=TOPIC_WORDS["income"])
    served = served.withColumn("key", F.array("sal"))
    return ready_for_join(served, "income", "code")


@query(
    "metric_layers",
    """WITH c AS (SELECT c_nationkey, count(*) AS customers, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM customer GROUP BY c_nationkey),
    l AS (SELECT c_nationkey, 'customers' AS metric, customers AS z FROM c
          UNION ALL SELECT c_nationkey, 'cents', cents FROM c)
    SELECT c_nationkey, metric, z, min(z) OVER (PARTITION BY metric) AS zmin, max(z) OVER (PARTITION BY metric) AS zmax FROM l""",
)
def metric_layers_query(t):
    wide = t.customer.groupBy("c_nationkey").agg(
        F.count("*").alias("customers"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents")
    )
    return metric_layers(wide, ["c_nationkey"], ["customers", "cents"])


SQL_TOPIC_TABLE = f"""a AS ({SQL_AREAS}), p AS ({SQL_AREA_POSTS}), m AS ({sql_topic_views('p', 'sal')}),
    w AS (SELECT code, name, {COLUMNS} FROM a LEFT JOIN m ON code = sal
          WHERE state = 'ASIA' AND coalesce({COLUMNS}) IS NOT NULL)"""


@query(
    "topic_region_table",
    f"WITH {SQL_TOPIC_TABLE} SELECT * FROM w",
)
def topic_region_table_query(t):
    table = topic_region_table(
        area_posts(t.posts), t.areas, "code", "state", state="ASIA", topics=TOPIC_WORDS
    )
    return table.drop("state")


@query(
    "topic_map",
    f"WITH {SQL_TOPIC_TABLE}, l AS ("
    + " UNION ALL ".join(
        f"SELECT code, name, '{c}' AS metric, CAST(\"{c}\" AS DOUBLE) AS z FROM w" for c in topic_columns()
    )
    + """) SELECT code, name, metric, z, min(z) OVER (PARTITION BY metric) AS zmin,
    max(z) OVER (PARTITION BY metric) AS zmax FROM l""",
)
def topic_map(t):
    return topic_map_job(
        area_posts(t.posts), t.areas, "code", "name", "state", state="ASIA", topics=TOPIC_WORDS
    )


SERVER_TOPICS = ["income", "sentiment"]
# Three distributions of posts, and two for each of three servers.
ROLES = {"SOCIAL": "system", "AU": "user", "TICTOC_SOCIAL": "assistant"}
DATASETS = {"posts": ["crime", "income", "sentiment"], **dict.fromkeys(SERVERS, SERVER_TOPICS)}


def _sql_distributions():
    parts = []
    turns = "(SELECT text AS content, CAST(length(text) % 9 + 1 AS INTEGER) AS score FROM conversations WHERE role = '{}')"
    sources = {"posts": f"({SQL_POSTS})", **{server: turns.format(role) for server, role in ROLES.items()}}
    for dataset, topics in DATASETS.items():
        for topic in topics:
            words = TOPIC_WORDS[topic]
            test = sql_mentions("content", words) if words else "TRUE"
            parts.append(
                f"SELECT '{dataset}' AS dataset, '{topic}' AS topic, CAST(r.s AS INTEGER) AS score, "
                f"count(x.score) AS \"count\" FROM range(1, 10) r(s) LEFT JOIN "
                f"(SELECT score FROM {sources[dataset]} q WHERE {test}) x ON x.score = r.s GROUP BY r.s"
            )
    return " UNION ALL ".join(parts)


@query("score_distributions", _sql_distributions())
def score_distributions_query(t):
    """All nine: the role of a turn stands for the server."""
    toots = t.conversations.select(
        "role", F.col("text").alias("content"), (F.length("text") % 9 + 1).cast("int").alias("score")
    )
    servers = {server: toots.where(F.col("role") == ROLES[server]) for server in SERVERS}
    return score_distributions({"posts": t.posts, **servers}, DATASETS, TOPIC_WORDS)


SQL_SCENARIO = f"""WITH p AS ({SQL_AREA_POSTS}), m AS ({sql_topic_views('p', 'sal')}),
    o AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, CAST(count(*) AS DOUBLE) AS customers,
          CAST(max(CAST(round(c_acctbal * 100) AS BIGINT)) AS DOUBLE) AS top FROM customer GROUP BY c_nationkey),
    w AS (SELECT * FROM m JOIN o ON sal = code)"""


def _sql_scenario():
    parts = []
    for topic in TOPIC_WORDS:
        n = f'"count {topic}"'
        band = f"CASE WHEN {n} <= 10 THEN '1-10' WHEN {n} <= 100 THEN '10-100' ELSE '>100' END"
        parts.append(f"SELECT 'bands' AS report, '{topic}' AS a, {band} AS b, CAST(count(*) AS DOUBLE) AS x FROM w WHERE {n} >= 1 GROUP BY 3")
        for metric in ("customers", "top"):
            y = f'"average_sentiment({topic})"'
            parts.append(
                f"SELECT 'correlations', 'average_sentiment({topic})', '{metric}', round(corr({y}, {metric}), 6) FROM w WHERE {y} IS NOT NULL"
            )
    for metric in [*topic_columns(TOPIC_WORDS), "customers", "top"]:
        for end, order in (("highest", "DESC"), ("lowest", "ASC")):
            parts.append(f"SELECT * FROM (SELECT 'extremes', '{metric} {end}', code, CAST(\"{metric}\" AS DOUBLE) FROM w WHERE \"{metric}\" IS NOT NULL ORDER BY \"{metric}\" {order}, code LIMIT 1)")
    return SQL_SCENARIO + " " + " UNION ALL ".join(parts)


@query("scenario_job", _sql_scenario())
def scenario_job_query(t):
    """The three reports of a scenario, one below the other."""
    official = t.customer.groupBy(F.col("c_nationkey").alias("code")).agg(
        F.count("*").alias("customers"), F.max(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("top")
    )
    found = scenario_job(area_posts(t.posts), official, "code", ["customers", "top"], TOPIC_WORDS)
    ends = found["extremes"]

    def rows(df, report, a, b, x):
        return df.select(F.lit(report).alias("report"), a.alias("a"), b.alias("b"), x.cast("double").alias("x"))

    return (
        rows(found["bands"], "bands", F.col("topic"), F.col("band"), F.col("regions"))
        .unionByName(rows(found["correlations"], "correlations", F.col("posts"), F.col("official"), F.round("correlation", 6)))
        .unionByName(rows(ends, "extremes", F.concat("metric", F.lit(" highest")), F.col("highest"), F.col("highest_value")))
        .unionByName(rows(ends, "extremes", F.concat("metric", F.lit(" lowest")), F.col("lowest"), F.col("lowest_value")))
    )
