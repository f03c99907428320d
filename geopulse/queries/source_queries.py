"""Sources and sinks: tables are written out in each format and read back."""

from pyspark.sql import functions as F

from geopulse.operators import views
from geopulse.operators.docstore import with_generated_ids
from geopulse.plans.jobs import gazetteer_job
from geopulse.queries.place_queries import SQL_GAZETTEER, part_places
from geopulse.queries.registry import SQL_POSTS, literal_table, query
from geopulse.session import scratch_path
from geopulse.sources import posts as post_source
from geopulse.sources import sinks, tables


def post_line(t):
    """Documents written as post lines: some ids too short, some fields missing."""
    body = F.struct(
        F.col("id"),
        F.struct(F.col("tags"), F.lit("a|b").alias("tokens")).alias("value"),
        F.struct(
            F.struct("author_id", "created_at", "text").alias("data"),
            F.struct(F.array(F.struct("full_name")).alias("places")).alias("includes"),
        ).alias("doc"),
    )
    source = t.documents.selectExpr(
        "CASE WHEN doc_id % 17 = 0 THEN CAST(doc_id AS STRING) ELSE CAST(100000000000000000 + doc_id AS STRING) END AS id",
        "source || '|' || lang AS tags",
        "CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 97 AS STRING) END AS author_id",
        "'2022-02-10T04:47:05.000Z' AS created_at",
        "CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'he said \"no\" twice' ELSE text END AS text",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Nation_' || (doc_id % 25) || ' - Middle East, ' || source END AS full_name",
    )
    return source.select(F.concat(F.to_json(body), F.lit(",")).alias("value"))


SQL_LINE_FIELDS = """raw AS (SELECT doc_id,
    CASE WHEN doc_id % 17 = 0 THEN CAST(doc_id AS VARCHAR) ELSE CAST(100000000000000000 + doc_id AS VARCHAR) END AS tid,
    source || '|' || lang AS tags,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(doc_id % 97 AS VARCHAR) END AS author,
    '2022-02-10T04:47:05.000Z' AS date,
    CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 29 = 0 THEN 'he said "no" twice' ELSE text END AS text,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Nation_' || (doc_id % 25) || ' - Middle East, ' || source END AS location
    FROM documents),
    fields AS (SELECT tid, author, date, location, tags, text AS decoded, CASE WHEN text IS NULL THEN NULL
        ELSE regexp_extract(CAST(to_json(text) AS VARCHAR), '^"(.*?)"', 1) END AS text FROM raw)"""


def post_lines(t):
    """The lines as a text dump with a header and a footer line."""
    path = scratch_path(t.spark, "posts")
    head = literal_table(t.spark, ["('{\"total_rows\":0,\"offset\":0,\"rows\":[')", "(']}')"], ["value"])
    # Files that cannot be split, so each is a small one.
    lines = post_line(t).unionAll(head).write.option("compression", "gzip").option("maxRecordsPerFile", 10_000)
    lines.text(path)
    return post_source.read_post_lines(t.spark, path)


@query("extract_fields", f"WITH {SQL_LINE_FIELDS} SELECT tid, author, date, location, tags, text FROM fields")
def extract_fields(t):
    return post_source.extract_fields(post_lines(t))


@query(
    "extract_fields_json",
    f"WITH {SQL_LINE_FIELDS} SELECT tid, author, date, location, tags, 'a|b' AS tokens, decoded AS text FROM fields",
)
def extract_fields_json(t):
    return post_source.extract_fields(post_lines(t), mode="json")


@query(
    "post_array",
    """SELECT CAST(doc_id AS VARCHAR) AS _id, source AS author_id, lang AS created_at, text,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Place ' || source END AS full_name FROM documents""",
)
def post_array(t):
    """Pretty-printed arrays, fields over several lines."""
    path = scratch_path(t.spark, "array")
    docs = t.documents.selectExpr(
        "doc_id", "CAST(doc_id AS STRING) AS _id", "source AS author_id", "lang AS created_at", "text",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'Place ' || source END AS full_name",
    )
    quoted = F.expr("substr(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    pretty = docs.select(
        F.concat(
            # Spacing varies from object to object.
            F.expr("CASE doc_id % 3 WHEN 0 THEN '  {\\n    \"_id\": \"' WHEN 1 THEN '{\"_id\" : \"' ELSE '{ \"_id\"\\n  :\\t\"' END"), "_id", F.lit('",\n    "author_id": "'), "author_id",
            F.lit('",\n    "created_at": "'), "created_at", F.lit('",\n    "text": '), quoted,
            F.coalesce(F.concat(F.lit(',\n    "full_name": "'), "full_name", F.lit('"')), F.lit("")),
            F.lit("\n  }"),
        ).alias("object")
    )

    sinks.framed(pretty, "object", "[\n", ",\n", "]").write.text(path)
    return post_source.read_post_array(t.spark, path)


@query(
    "official_csv",
    """SELECT CAST(c_custkey AS INTEGER) AS area, c_mktsegment AS " name", c_acctbal AS " mean_aud",
    CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS " code" FROM customer""",
)
def official_csv(t):
    path = scratch_path(t.spark, "csv")
    rows = t.customer.selectExpr(
        "CAST(c_custkey AS INT) AS area", "c_mktsegment AS ` name`", "c_acctbal AS ` mean_aud`",
        "CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS ` code`",
    )
    rows.write.option("header", True).option("ignoreLeadingWhiteSpace", False).csv(path)
    return tables.read_official_csv(t.spark, path)


def place_dict_file(t):
    """Part places as one JSON dictionary per file."""
    path = scratch_path(t.spark, "places")
    entries = part_places(t).groupBy("location").agg(F.max_by(F.struct("gcc", "sal"), "ord").alias("v"))
    text = entries.select(
        F.concat(
            F.lit('"'), "location", F.lit('": {"ste": "1", "gcc": "'), "v.gcc", F.lit('", "sal": "'), "v.sal", F.lit('"}')
        ).alias("document")
    )

    sinks.framed(text, "document", "{", ", ", "}").write.text(path)
    return path


SQL_DICT = """d AS (SELECT location, gcc, sal FROM (SELECT p_name || ' (' || lower(p_type) || '.) - ' || (p_size % 7) AS location,
    p_brand AS gcc, CAST(p_partkey AS VARCHAR) AS sal,
    row_number() OVER (PARTITION BY p_name || ' (' || lower(p_type) || '.) - ' || (p_size % 7) ORDER BY p_partkey DESC) AS rk FROM part)
    WHERE rk = 1)"""


@query("place_dict", f"WITH {SQL_DICT} SELECT location, '1' AS ste, gcc, sal FROM d")
def place_dict(t):
    return tables.read_place_dict(t.spark, place_dict_file(t)).drop("ord")


@query("gazetteer_job", f"WITH {SQL_DICT}, places AS (SELECT location, gcc, sal, 1 AS ord FROM d), "
       f"{SQL_GAZETTEER} SELECT location, count(*) AS entries FROM gazetteer GROUP BY location")
def gazetteer_job_query(t):
    out = gazetteer_job(t.spark, place_dict_file(t), scratch_path(t.spark, "gazetteer"))
    # Which of several places owns a pair depends on the order of the file.
    return out.groupBy("location").agg(F.count("*").alias("entries"))


@query(
    "read_regions",
    """SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, r_name AS state, 'POINT(' || n_nationkey || ')' AS geometry
    FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
def read_regions(t):
    path = scratch_path(t.spark, "regions")
    t.areas.selectExpr("code AS SAL_CODE", "name AS SAL_NAME", "state AS STE_NAME", "'POINT(' || code || ')' AS geo").write.parquet(path)
    return tables.read_regions(t.spark, path, "SAL_CODE", "SAL_NAME", "STE_NAME", "geo")


@query(
    "read_regions_geojson",
    """SELECT CAST(c_custkey AS VARCHAR) AS code, c_name || ' {"' || c_mktsegment || '\\"}' AS name,
    CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE n_name END AS state,
    '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[' || c_nationkey || ',' || c_custkey || ']}]}' AS geometry
    FROM customer JOIN nation ON c_nationkey = n_nationkey""",
)
def read_regions_geojson(t):
    """Customers as regions of their nation in feature collections: geometries nest, names have braces and quotes."""
    path = scratch_path(t.spark, "geojson")
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.expr("c_name || ' {\"' || c_mktsegment || '\\\\\"}'")
    properties = F.to_json(F.struct(F.col("c_custkey").alias("SAL_CODE"), text.alias("SAL_NAME"), F.when(F.col("c_custkey") % 7 != 0, F.col("n_name")).alias("STE_NAME")))
    geometry = F.concat(F.lit('{"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": ['), "c_nationkey", F.lit(", "), "c_custkey", F.lit("]}]}"))
    first = F.concat(F.lit('{"type": "Feature", "properties": '), properties, F.lit(', "geometry": '), geometry, F.lit("}"))
    last = F.concat(F.lit('{"geometry": '), geometry, F.lit(',\n  "properties":'), properties, F.lit(', "type": "Feature"\n }'))
    features = rows.select(F.when(F.col("c_custkey") % 2 == 0, first).otherwise(last).alias("feature"))
    opening = '{"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "any"}}, "features": [\n'
    sinks.framed(features, "feature", opening, ",\n", "]}").write.text(path)
    return tables.read_regions(t.spark, path, "SAL_CODE", "SAL_NAME", "STE_NAME", "geometry", format="geojson")


@query(
    "flatten_view",
    f"""WITH p AS ({SQL_POSTS}) SELECT sal AS key, CAST(sum(score) AS DOUBLE) AS "sum", count(*) AS "count",
    CAST(min(score) AS DOUBLE) AS "min", CAST(max(score) AS DOUBLE) AS "max", CAST(sum(score * score) AS DOUBLE) AS sumsqr
    FROM p GROUP BY sal""",
)
def flatten_view(t):
    path = scratch_path(t.spark, "view")
    rows = views.view(t.posts, ["sal"]).select(
        F.array("sal").alias("key"), F.struct("sum", "count", "min", "max", "sumsqr").alias("value")
    )
    sinks.write_json_array(rows, path)
    return tables.flatten_view(tables.read_view(t.spark, path)).withColumn("key", F.col("key")[0])


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(t):
    return t.events.select("event_id", F.from_json("props", "k BIGINT")["k"].alias("k"))


@query("write_batched", "SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem")
def write_batched(t):
    path = scratch_path(t.spark, "batched")
    rows = t.lineitem.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    sinks.write_batched(rows, path, n=50_000, partition_by=["l_returnflag"])
    return t.spark.read.parquet(path)


@query("write_json_array", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey FROM orders")
def write_json_array(t):
    path = scratch_path(t.spark, "json")
    rows = t.orders.selectExpr(
        "o_orderkey", "o_orderstatus", "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey END AS o_custkey"
    )
    sinks.write_json_array(rows, path)
    schema = "o_orderkey BIGINT, o_orderstatus STRING, o_custkey BIGINT"
    return t.spark.read.schema(schema).option("multiLine", True).json(path)


@query("write_json_gzip", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def write_json_gzip(t):
    path = scratch_path(t.spark, "gzip")
    sinks.write_json(t.supplier.select("s_suppkey", "s_name", "s_nationkey"), path, compression="gzip")
    return t.spark.read.schema("s_suppkey BIGINT, s_name STRING, s_nationkey INT").json(path)


@query("materialise", "SELECT c_mktsegment, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY c_mktsegment")
def materialise(t):
    """The second call finds the result and keeps it, the third replaces it."""
    path = scratch_path(t.spark, "named")
    first = t.customer.groupBy("c_mktsegment").agg(F.count("*").alias("n"))
    sinks.materialise(first, path)
    sinks.materialise(first.limit(0), path)
    kept = t.spark.read.parquet(path).count()
    wanted = t.customer.groupBy("c_mktsegment").agg(F.countDistinct("c_nationkey").alias("n"))
    return sinks.materialise(wanted, path, force=kept > 0)


@query(
    "to_documents",
    """SELECT '{"s_suppkey":' || s_suppkey || ',"s_name":"' || s_name || '","gone":null}' AS document FROM supplier""",
)
def to_documents(t):
    rows = t.supplier.select("s_suppkey", "s_name", F.lit(None).cast("string").alias("gone"))
    return sinks.to_documents(rows)


@query("generated_ids", "SELECT count(*) AS documents, count(*) AS ids FROM supplier")
def generated_ids(t):
    named = with_generated_ids(
        t.supplier.withColumn("_id", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")))
    )
    return named.agg(F.count("*").alias("documents"), F.countDistinct("_id").alias("ids"))
