"""Gazetteer and place resolution."""

from pyspark.sql import functions as F

from geopulse.functions.text import normalise_location, place_name
from geopulse.operators import gazetteer as gz
from geopulse.queries.registry import Tables, query, sql_place
from geopulse.session import scratch_path
from geopulse.sources.sinks import load_gazetteer, save_gazetteer


def places(t: Tables):
    """Places from nations, regions and their combinations, in a fixed order."""
    joined = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    regions = t.region.select(
        F.lower("r_name").alias("location"), F.lit("g0").alias("gcc"),
        F.concat(F.lit("R"), "r_regionkey").alias("sal"), F.col("r_regionkey").cast("int").alias("ord"),
    )
    nations = t.nation.select(
        F.lower("n_name").alias("location"), F.lit("g1").alias("gcc"),
        F.concat(F.lit("N"), "n_nationkey").alias("sal"), (F.col("n_nationkey") + 100).cast("int").alias("ord"),
    )
    combined = joined.select(
        F.expr("lower(n_name || ' - ' || r_name || ' (old.)')").alias("location"), F.lit("g2").alias("gcc"),
        F.concat(F.lit("C"), "n_nationkey").alias("sal"), (F.col("n_nationkey") + 200).cast("int").alias("ord"),
    )
    return regions.unionByName(nations).unionByName(combined)


def part_places(t: Tables):
    """Gazetteer that grows with the part table; many names repeat, so the last one counts."""
    return t.part.select(
        F.expr("p_name || ' (' || lower(p_type) || '.) - ' || (p_size % 7)").alias("location"),
        F.col("p_brand").alias("gcc"),
        F.col("p_partkey").cast("string").alias("sal"),
        F.col("p_partkey").cast("int").alias("ord"),
    )


SQL_PLACES = """
    joined AS (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey),
    places AS (
      SELECT lower(r_name) AS location, 'g0' AS gcc, 'R' || r_regionkey AS sal, r_regionkey AS ord FROM region
      UNION ALL SELECT lower(n_name), 'g1', 'N' || n_nationkey, n_nationkey + 100 FROM nation
      UNION ALL SELECT lower(n_name || ' - ' || r_name || ' (old.)'), 'g2', 'C' || n_nationkey, n_nationkey + 200
      FROM joined)"""
SQL_PART_PLACES = """
    places AS (SELECT p_name || ' (' || lower(p_type) || '.) - ' || (p_size % 7) AS location, p_brand AS gcc,
                      CAST(p_partkey AS VARCHAR) AS sal, p_partkey AS ord FROM part)"""
SQL_GAZETTEER = """
    names AS (SELECT replace(replace(replace(replace(location, '(', ''), ')', ''), ' - ', ' '), '.', '') AS location,
                     gcc, sal, ord FROM places),
    cut AS (SELECT location AS real_loc, gcc, sal, ord, string_split(location, ' ') AS w FROM names),
    grams AS (SELECT real_loc, gcc, sal, ord, w, unnest(range(1, len(w))) AS i FROM cut WHERE len(w) > 2),
    every AS (SELECT location, gcc, sal, location AS real_loc, CAST(ord AS BIGINT) AS o FROM names
              UNION ALL
              SELECT w[i] || ' ' || w[i + 1], gcc, sal, real_loc, 1000000000000 + CAST(ord AS BIGINT) * 1000 + i FROM grams),
    gazetteer AS (SELECT location, gcc, sal, real_loc FROM (
        SELECT *, row_number() OVER (PARTITION BY location ORDER BY o DESC) AS rk FROM every) WHERE rk = 1)"""


@query(
    "gazetteer_build",
    f"WITH {SQL_PART_PLACES}, {SQL_GAZETTEER} SELECT location, gcc, sal, real_loc FROM gazetteer",
)
def gazetteer_build(t):
    return gz.build_gazetteer(part_places(t)).drop("ord")


@query(
    "gazetteer_saved",
    f"WITH {SQL_PLACES}, {SQL_GAZETTEER} SELECT location, gcc, sal, real_loc FROM gazetteer",
)
def gazetteer_saved(t):
    path = scratch_path(t.spark, "gazetteer")
    save_gazetteer(gz.build_gazetteer(places(t)).drop("ord"), path)
    return load_gazetteer(t.spark, path)


CUSTOMER_PLACE = (
    "c_name || ', ' || CASE WHEN c_custkey % 5 = 0 THEN 'Old ' ELSE '' END || CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' ELSE n_name END || ' - ' || "
    "CASE WHEN c_custkey % 4 = 0 THEN '' ELSE r_name END || CASE WHEN c_custkey % 3 = 0 THEN ' Old' ELSE ' x' END"
)


def customer_places(t: Tables):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(
        t.region, F.col("n_regionkey") == F.col("r_regionkey")
    )
    return joined.select("c_custkey", normalise_location(F.lower(F.expr(CUSTOMER_PLACE))).alias("place"))


def sql_resolved(source, place="place", key="c_custkey"):
    """CTE ``resolved``: brute force over all word choices of every distinct place."""
    return f"""
    pw AS (SELECT DISTINCT {place} AS place, string_split({place}, ' ') AS w FROM {source}),
    pm AS (SELECT place, w, unnest(range(1, CAST(pow(2, len(w)) AS BIGINT))) AS mask FROM pw),
    pb AS (SELECT place, mask, w, unnest(range(0, len(w))) AS i FROM pm),
    pc AS (SELECT place, mask, string_agg(w[i + 1], ' ' ORDER BY i) AS cand, count(*) AS n,
                  string_agg(lpad(CAST(i AS VARCHAR), 3, '0'), ',' ORDER BY i) AS spots
           FROM pb WHERE (mask >> i) & 1 = 1 GROUP BY place, mask),
    hits AS (SELECT place, cand, sal, row_number() OVER (PARTITION BY place ORDER BY n, spots) AS rk
             FROM pc JOIN gazetteer ON cand = location WHERE sal <> ''),
    resolved AS (SELECT place, cand, hits.sal AS sal, gcc, real_loc FROM hits JOIN gazetteer ON cand = location WHERE rk = 1)"""


SQL_CUSTOMER_PLACES = f"""
    cp AS (SELECT c_custkey, {sql_place('lower(' + CUSTOMER_PLACE + ')')} AS place
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(
    "resolve_location",
    f"""WITH {SQL_PLACES}, {SQL_GAZETTEER}, {SQL_CUSTOMER_PLACES}, {sql_resolved('cp')}
    SELECT cp.c_custkey, sal FROM cp LEFT JOIN resolved r ON cp.place = r.place""",
)
def resolve_location(t):
    gazetteer = gz.build_gazetteer(places(t))
    return gz.resolve_location(customer_places(t), gazetteer, "place", ["c_custkey"]).select("c_custkey", "sal")


@query(
    "resolve_location_match",
    f"""WITH {SQL_PLACES}, {SQL_GAZETTEER}, {SQL_CUSTOMER_PLACES}, {sql_resolved('cp')}
    SELECT cp.c_custkey, cand AS matched, sal || '/' || gcc || '/' || real_loc AS entry,
    CASE WHEN sal IS NULL THEN 0 ELSE 1 END AS entries
    FROM cp LEFT JOIN resolved r ON cp.place = r.place""",
)
def resolve_location_match(t):
    gazetteer = gz.build_gazetteer(places(t))
    found = gz.resolve_location(
        customer_places(t), gazetteer, "place", ["c_custkey"], keep_match=True
    )
    entry = F.get(F.map_values("possible_suburb"), F.lit(0))
    return found.select(
        "c_custkey",
        F.get(F.map_keys("possible_suburb"), F.lit(0)).alias("matched"),
        F.concat(*[x for c in ("sal", "gcc", "real_loc") for x in (entry[c], F.lit("/"))][:-1]).alias("entry"),
        F.size("possible_suburb").alias("entries"),
    )


@query(
    "resolve_location_joined",
    f"""WITH {SQL_PART_PLACES}, {SQL_GAZETTEER},
    pp AS (SELECT p_partkey, replace(replace(place, '(', ''), ')', '') AS place FROM (
        SELECT p_partkey, 'the ' || p_name || ' and ' || lower(p_type) || ' ' || (p_size % 11) AS place FROM part)),
    {sql_resolved('pp')}
    SELECT pp.p_partkey, sal FROM pp LEFT JOIN resolved r ON pp.place = r.place""",
)
def resolve_location_joined(t):
    """The way taken when a gazetteer is too large for a lookup."""
    posts = t.part.select(
        "p_partkey",
        place_name(F.expr("'the ' || p_name || ' and ' || lower(p_type) || ' ' || (p_size % 11)")).alias("place"),
    )
    gazetteer = gz.build_gazetteer(part_places(t))
    return gz.resolve_location(posts, gazetteer, "place", ["p_partkey"], max_rows=0).select("p_partkey", "sal")
