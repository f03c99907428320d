"""Document operations and paging."""

from pyspark.sql import functions as F

from geopulse.operators import docstore, paging
from geopulse.operators.keyindex import KeyIndex
from geopulse.operators.filters import geo_only, require, row_sum, valid_id
from geopulse.queries.registry import query
from geopulse.session import scratch_path


def base(t):
    """Customers as stored documents of version 1."""
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("_id"), "c_name", "c_mktsegment",
        F.round(F.col("c_acctbal") * 100).cast("bigint").alias("cents"), F.lit(1).cast("bigint").alias("version"),
    )


def updates(t):
    """Orders that write to customers: some known, some new, several per customer."""
    return t.orders.select(
        F.when(F.col("o_orderkey") % 30 == 0, F.concat(F.lit("n"), "o_custkey"))
        .otherwise(F.col("o_custkey").cast("string")).alias("_id"),
        F.col("o_orderpriority").alias("c_name"), F.col("o_orderstatus").alias("c_mktsegment"),
        F.col("o_orderkey").alias("cents"), F.col("o_orderkey").alias("ord"),
    )


SQL_BASE = """b AS (SELECT CAST(c_custkey AS VARCHAR) AS _id, c_name, c_mktsegment,
    CAST(round(c_acctbal * 100) AS BIGINT) AS cents, CAST(1 AS BIGINT) AS version FROM customer)"""
SQL_UPDATES = """u AS (SELECT CASE WHEN o_orderkey % 30 = 0 THEN 'n' || o_custkey ELSE CAST(o_custkey AS VARCHAR) END AS _id,
    o_orderpriority AS c_name, o_orderstatus AS c_mktsegment, o_orderkey AS cents FROM orders)"""


@query(
    "upsert",
    f"""WITH {SQL_BASE}, {SQL_UPDATES},
    r AS (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY cents DESC) AS rk,
                 count(*) OVER (PARTITION BY _id) AS saves FROM u),
    l AS (SELECT * FROM r WHERE rk = 1)
    SELECT coalesce(b._id, l._id) AS _id, coalesce(l.c_name, b.c_name) AS c_name,
    coalesce(l.c_mktsegment, b.c_mktsegment) AS c_mktsegment, coalesce(l.cents, b.cents) AS cents,
    coalesce(version, 0) + coalesce(saves, 0) AS version FROM b FULL JOIN l ON b._id = l._id""",
)
def upsert(t):
    return docstore.upsert(base(t), updates(t), order_col="ord")


@query(
    "bulk_insert",
    f"""WITH {SQL_BASE}, {SQL_UPDATES},
    r AS (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY cents) AS rk FROM u)
    SELECT _id, c_name, c_mktsegment, cents, CAST(1 AS BIGINT) AS version FROM r
    WHERE rk = 1 AND _id NOT IN (SELECT _id FROM b)""",
)
def bulk_insert(t):
    inserted, _ = docstore.bulk_insert(base(t), updates(t), order_col="ord")
    return inserted.drop("ord")


@query(
    "bulk_without_ids",
    """SELECT o_orderpriority AS c_name, count(*) AS documents, count(*) AS ids FROM orders
    WHERE o_orderkey % 3 = 0 GROUP BY o_orderpriority""",
)
def bulk_without_ids(t):
    """A third of the documents come without an id; all of them are stored, each under its own."""
    new = updates(t).withColumn("_id", F.when(F.col("cents") % 3 != 0, F.concat(F.lit("o"), "cents")))
    inserted, _ = docstore.bulk_insert(base(t), new, order_col="ord")
    minted = inserted.where(~F.col("_id").startswith("o"))
    return minted.groupBy("c_name").agg(F.count("*").alias("documents"), F.countDistinct("_id").alias("ids"))


@query(
    "bulk_conflicts",
    f"""WITH {SQL_BASE}, {SQL_UPDATES}, c AS (SELECT _id, count(*) AS n FROM u GROUP BY _id)
    SELECT c._id, CASE WHEN b._id IS NULL THEN n - 1 ELSE n END AS rejected FROM c LEFT JOIN b ON b._id = c._id
    WHERE b._id IS NOT NULL OR n > 1""",
)
def bulk_conflicts(t):
    return docstore.bulk_insert(base(t), updates(t), order_col="ord")[1]


@query(
    "get_documents",
    f"WITH {SQL_BASE}, {SQL_UPDATES} SELECT * FROM b WHERE _id IN (SELECT _id FROM u)",
)
def get_documents(t):
    return docstore.get_documents(base(t), updates(t))


@query(
    "delete_documents",
    f"WITH {SQL_BASE}, {SQL_UPDATES} SELECT * FROM b WHERE _id NOT IN (SELECT _id FROM u)",
)
def delete_documents(t):
    return docstore.delete_documents(base(t), updates(t))[0]


@query(
    "delete_missing",
    f"WITH {SQL_BASE}, {SQL_UPDATES} SELECT DISTINCT _id FROM u WHERE _id NOT IN (SELECT _id FROM b)",
)
def delete_missing(t):
    return docstore.delete_documents(base(t), updates(t))[1]


def patches(t):
    """Orders patch their customer, most of them several times: a new name, or an explicit NULL segment."""
    order = F.col("o_orderkey")
    return t.orders.select(
        F.when(order % 10 == 0, F.concat(F.lit("x"), "o_custkey")).otherwise(F.col("o_custkey").cast("string")).alias("_id"),
        F.col("o_orderpriority").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment"),
        F.when(order % 2 == 0, F.array(F.lit("c_name")))
        .when(order % 7 == 0, F.array(F.lit("c_name"), F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("fields"),
        order.alias("ord"),
    )


@query(
    "patch",
    f"""WITH {SQL_BASE}, p AS (SELECT CAST(o_custkey AS VARCHAR) AS _id, count(*) AS saves,
        arg_max(o_orderpriority, o_orderkey) FILTER (WHERE o_orderkey % 2 = 0 OR o_orderkey % 7 = 0) AS name,
        count(*) FILTER (WHERE o_orderkey % 2 = 1 AND o_orderkey % 7 = 0) AS nulled
        FROM orders WHERE o_orderkey % 10 <> 0 GROUP BY o_custkey)
    SELECT b._id, coalesce(name, c_name) AS c_name, CASE WHEN nulled > 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment,
    cents, version + coalesce(saves, 0) AS version FROM b LEFT JOIN p ON b._id = p._id""",
)
def patch(t):
    return docstore.patch(base(t), patches(t), "ord")[0]


@query("patch_missing", "SELECT DISTINCT 'x' || o_custkey AS _id FROM orders WHERE o_orderkey % 10 = 0")
def patch_missing(t):
    return docstore.patch(base(t), patches(t), "ord")[1]


@query("last_documents", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 25")
def last_documents(t):
    return docstore.last_documents(t.events, 25, "event_id").select("event_id", "user_id")


@query("high_water_mark", "SELECT event_type, max(event_id) AS event_id FROM events GROUP BY event_type")
def high_water_mark(t):
    return docstore.high_water_mark(t.events, "event_id", "event_type")


@query(
    "doc_id",
    """SELECT CAST(doc_id AS VARCHAR) AS tid,
    (('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 4) || ':' || doc_id AS _id FROM documents""",
)
def doc_id(t):
    posts = t.documents.select(F.col("doc_id").cast("string").alias("tid"))
    return docstore.with_doc_id(posts)


@query("page_after", "SELECT event_id FROM events WHERE event_id > 150 ORDER BY event_id LIMIT 40")
def page_after(t):
    return paging.page_after(t.events, 150, by="event_id").select("event_id")


@query("page_before", "SELECT event_id FROM events WHERE event_id < 150 ORDER BY event_id DESC LIMIT 1")
def page_before(t):
    return paging.page_before(t.events, 150, by="event_id").select("event_id")


@query(
    "next_pages",
    """WITH s AS (SELECT event_type AS server, event_id AS tid, value FROM events),
    m AS (SELECT server, max(tid) AS mark FROM s WHERE tid % 3 = 0 AND tid < (SELECT max(tid) / 2 FROM s) AND server <> 'view' GROUP BY server)
    SELECT server, tid, value FROM (SELECT s.server AS server, tid, value, row_number() OVER (PARTITION BY s.server ORDER BY tid) AS rk
    FROM s LEFT JOIN m ON s.server = m.server WHERE mark IS NULL OR tid > mark) WHERE rk <= 40""",
)
def next_pages(t):
    source = t.events.selectExpr("event_type AS server", "event_id AS tid", "value")
    half = source.agg(F.max("tid") / 2).first()[0] or 0
    stored = source.where("tid % 3 = 0 AND server <> 'view'").where(F.col("tid") < half)
    return paging.next_pages(source, stored)


@query(
    "id_range_for_dates",
    """SELECT min(event_id) AS min_id, max(event_id) AS max_id, count(*) AS posts FROM events
    WHERE CAST(ts + INTERVAL 11 HOUR AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'""",
)
def id_range_for_dates(t):
    return paging.id_range_for_dates(
        t.events, "2024-01-05", "2024-01-07", "Australia/Melbourne", by="event_id"
    )


@query(
    "valid_complete_posts",
    """SELECT tid, content, place FROM (SELECT CAST(100000000000000 + doc_id * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 7 END AS VARCHAR) AS tid,
    CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS content,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS place FROM documents)
    WHERE length(tid) >= 15 AND content <> '' AND place IS NOT NULL""",
)
def valid_complete_posts(t):
    posts = t.documents.selectExpr(
        "CAST(100000000000000 + doc_id * CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 7 END AS STRING) AS tid",
        "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 7 = 0 THEN NULL ELSE text END AS content",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS place",
    )
    return geo_only(require(valid_id(posts), ["content"]), "place")


@query(
    "row_sum",
    """SELECT l_orderkey, l_partkey, l_linenumber, CAST(l_quantity AS BIGINT) + l_linenumber +
    coalesce(CASE WHEN l_returnflag = 'A' THEN l_suppkey END, 0) AS total FROM lineitem""",
)
def row_sum_query(t):
    lines = t.lineitem.selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber", "CAST(l_quantity AS BIGINT) AS q",
        "CASE WHEN l_returnflag = 'A' THEN l_suppkey END AS s",
    )
    return row_sum(lines, ["q", "l_linenumber", "s"], "total").drop("q", "s")


def order_store(t):
    """Orders as posts of three servers, several files each, with their key index."""
    path = scratch_path(t.spark, "orders")
    rows = t.orders.select(F.col("o_orderkey").alias("tid"), "o_custkey", F.col("o_orderstatus").alias("server"))
    rows.repartitionByRange(6, "tid").write.partitionBy("server").parquet(path)
    index = KeyIndex(t.spark, path, "tid", "server", "tid BIGINT, server STRING")
    index.update()
    return index


@query(
    "page_from_index",
    """SELECT * FROM (SELECT o_orderkey AS tid, o_custkey, o_orderstatus AS server FROM orders
        WHERE o_orderkey > (SELECT max(o_orderkey) // 2 FROM orders) ORDER BY 1 LIMIT 40)
    UNION ALL SELECT * FROM (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY 1 DESC LIMIT 7)""",
)
def page_from_index(t):
    """The page above a cursor, and the newest rows: only files that may hold them are read."""
    index = order_store(t)
    cursor = t.orders.agg(F.max("o_orderkey")).first()[0] // 2
    return index.page_after(cursor, 40).unionByName(index.page_before(None, 7))


@query("marks_from_index", "SELECT o_orderstatus AS bucket, max(o_orderkey) AS mark FROM orders GROUP BY 1")
def marks_from_index(t):
    return order_store(t).marks()
