"""Official tables: description, outliers, maps and comparison with posts."""

from pyspark.sql import functions as F

from geopulse.operators import official
from geopulse.operators.filters import drop_any_null, fill_zero
from geopulse.operators.views import topic_views
from geopulse.plans.jobs import crime_map_job, crime_summary, crime_table, income_map_job, income_table
from geopulse.queries.registry import (
    SQL_AREAS, SQL_POSTS, TOPIC_WORDS, query, sql_mentions, sql_round,
)


def sql_describe(source, cols):
    parts = []
    for c in cols:
        x = f'CAST("{c}" AS DOUBLE)'
        qs = ", ".join(
            f"{sql_round(f'quantile_cont({x}, {p})')} AS q{round(p * 100)}" for p in (0.0, 0.25, 0.5, 0.75, 1.0)
        )
        parts.append(
            f"SELECT '{c}' AS metric, count({x}) AS \"count\", {sql_round(f'avg({x})')} AS mean, "
            f"{sql_round(f'stddev_samp({x})')} AS std, {sql_round(f'min({x})')} AS \"min\", {qs}, "
            f"{sql_round(f'max({x})')} AS \"max\" FROM {source}"
        )
    return " UNION ALL ".join(parts)


def sql_fences(source, cols):
    """CTE ``fence`` with one row: lower and upper bound per column."""
    q = {c: [sql_round(f'quantile_cont(CAST("{c}" AS DOUBLE), {p})') for p in (0.25, 0.75)] for c in cols}
    ends = ", ".join(
        f'({a}) - 1.5 * (({b}) - ({a})) AS "lo {c}", ({b}) + 1.5 * (({b}) - ({a})) AS "hi {c}"'
        for c, (a, b) in q.items()
    )
    return f"fence AS (SELECT {ends} FROM {source})"


def sql_inside(cols):
    return " AND ".join(
        f'("{c}" IS NULL OR NOT ("{c}" < "lo {c}" OR "{c}" > "hi {c}"))' for c in cols
    )


@query("describe5", sql_describe("events", ["value", "user_id"]))
def describe5(t):
    return official.describe5(t.events, ["value", "user_id"])


@query("describe5_documents", sql_describe("documents", ["n_chars"]))
def describe5_documents(t):
    return official.describe5(t.documents, ["n_chars"])


@query(
    "drop_outliers",
    f"""WITH {sql_fences('events', ['value', 'user_id'])}
    SELECT event_id, value, user_id FROM events, fence WHERE {sql_inside(['value', 'user_id'])}""",
)
def drop_outliers(t):
    kept = official.drop_outliers(t.events, ["value", "user_id"])
    return kept.select("event_id", "value", "user_id")


@query(
    "fences",
    f"WITH d AS ({sql_describe('documents', ['n_chars'])}) "
    "SELECT metric, q25 - 1.5 * (q75 - q25) AS lower, q75 + 1.5 * (q75 - q25) AS upper FROM d",
)
def fences(t):
    return official.fences(official.describe5(t.documents, ["n_chars"]))


# Events as an official table of offences: missing values, repeated rows, values far out, and
# codes without a boundary.
OFFENCE_COLUMNS = {" a": "value", " b": "users", " c": "step"}
OFFENCE_ROWS = """SELECT event_id AS "event", CAST(user_id % 40 AS INTEGER) AS " code",
    CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN NULL ELSE value END AS " a",
    CAST(user_id AS DOUBLE) AS " b", CAST(event_id % 13 AS DOUBLE) AS " c" FROM events"""
OFFENCE_SQL = f"({OFFENCE_ROWS} UNION ALL SELECT * FROM ({OFFENCE_ROWS}) r WHERE \"event\" % 3 = 0)"
OFFENCE_METRICS = ["value", "users", "step"]
SQL_CRIME = f"""raw AS {OFFENCE_SQL},
    clean AS (SELECT DISTINCT "event", " code", coalesce(" a", 0) AS value, coalesce(" b", 0) AS users,
              coalesce(" c", 0) AS step FROM raw),
    {sql_fences('clean', OFFENCE_METRICS)},
    crime AS (SELECT "event", " code", value, users, step, value + users + step AS total
              FROM clean, fence WHERE {sql_inside(OFFENCE_METRICS)})"""


def offences(t):
    raw = t.events.select(
        F.col("event_id").alias("event"),
        (F.col("user_id") % 40).cast("int").alias(" code"),
        F.expr("CASE WHEN event_type = 'error' AND user_id % 7 = 0 THEN NULL ELSE value END").alias(" a"),
        F.col("user_id").cast("double").alias(" b"),
        (F.col("event_id") % 13).cast("double").alias(" c"),
    )
    return raw.unionByName(raw.where("event % 3 = 0"))


@query("crime_table", f"WITH {SQL_CRIME} SELECT \"event\", \" code\", value, users, step, round(total, 2) AS total FROM crime")
def crime_table_query(t):
    table = crime_table(offences(t), OFFENCE_COLUMNS, "total")
    return table.withColumn("total", F.round("total", 2))


SQL_MERGED = f"""a AS ({SQL_AREAS}), merged AS (
    SELECT "event", name, value, users, step, total FROM crime JOIN a ON CAST(code AS INTEGER) = " code")"""


@query(
    "crime_map",
    f"WITH {SQL_CRIME}, {SQL_MERGED}, l AS ("
    + " UNION ALL ".join(
        f"SELECT \"event\", name, '{c}' AS metric, round({c}, 2) AS z FROM merged" for c in [*OFFENCE_METRICS, "total"]
    )
    + """) SELECT "event", name, metric, z, min(z) OVER (PARTITION BY metric) AS zmin,
    max(z) OVER (PARTITION BY metric) AS zmax FROM l""",
)
def crime_map(t):
    layers = crime_map_job(
        offences(t), t.areas, " code", "code", ["event", "name"], OFFENCE_COLUMNS, "total"
    )
    return layers.select(
        "event", "name", "metric", *[F.round(c, 2).alias(c) for c in ("z", "zmin", "zmax")]
    )


@query("crime_summary", f"WITH {SQL_CRIME}, c AS (SELECT value, users, step, total FROM crime) "
       + sql_describe("c", [*OFFENCE_METRICS, "total"]))
def crime_summary_query(t):
    return crime_summary(offences(t), OFFENCE_COLUMNS, "total")


# Documents as an official income table of areas.
INCOME_COLUMNS = ["mean", "median", "sum", "age"]
INCOME_ROWS = """SELECT doc_id AS area, CAST(substr(source, 4) AS INTEGER) AS code,
    CAST(n_chars AS DOUBLE) AS mean, CASE WHEN doc_id % 41 = 0 THEN NULL ELSE CAST(n_chars % 997 AS DOUBLE) END AS median,
    CAST(n_chars * 3 AS DOUBLE) AS sum, CAST(n_chars * n_chars AS DOUBLE) AS age FROM documents"""
INCOME_SQL = INCOME_ROWS.replace(" AS sum,", ' AS "sum",').replace(" AS median,", ' AS "median",').replace("AS mean,", 'AS "mean",')
SQL_INCOME = f"""raw AS (SELECT DISTINCT * FROM ({INCOME_SQL} UNION ALL {INCOME_SQL}) WHERE "median" IS NOT NULL),
    a AS ({SQL_AREAS}),
    vic AS (SELECT area, name, state, raw.code AS code, "mean", "median", "sum", age FROM raw JOIN a ON raw.code = CAST(a.code AS INTEGER)
            WHERE state = 'ASIA'),
    {sql_fences('vic', ['mean', 'median', 'sum'])},
    income AS (SELECT area, name, state, code, "mean", "median", "sum", age FROM vic, fence
               WHERE {sql_inside(['mean', 'median', 'sum'])})"""


def incomes(t):
    raw = t.documents.selectExpr(
        "doc_id AS area", "CAST(substr(source, 4) AS INT) AS code", "CAST(n_chars AS DOUBLE) AS mean",
        "CASE WHEN doc_id % 41 = 0 THEN NULL ELSE CAST(n_chars % 997 AS DOUBLE) END AS median",
        "CAST(n_chars * 3 AS DOUBLE) AS sum", "CAST(n_chars * n_chars AS DOUBLE) AS age",
    )
    return raw.unionByName(raw)


@query("income_table", f"WITH {SQL_INCOME} SELECT * FROM income")
def income_table_query(t):
    return income_table(
        incomes(t), t.areas, "code", "code", "state", "ASIA", INCOME_COLUMNS, ["mean", "median", "sum"]
    )


@query(
    "income_map",
    f"WITH {SQL_INCOME}, l AS ("
    + " UNION ALL ".join(f"SELECT area, name, '{c}' AS metric, \"{c}\" AS z FROM income" for c in INCOME_COLUMNS)
    + """) SELECT area, name, metric, z, min(z) OVER (PARTITION BY metric) AS zmin,
    max(z) OVER (PARTITION BY metric) AS zmax FROM l""",
)
def income_map(t):
    return income_map_job(
        incomes(t), t.areas, "code", "code", ["area", "name"], "state", "ASIA",
        INCOME_COLUMNS, ["mean", "median", "sum"],
    )


@query(
    "regroup",
    """SELECT r_name, round(avg(CAST(round(c_acctbal * 100) AS BIGINT)), 4) AS avg_cents,
    CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS sum_cents, count(*) AS areas
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name""",
)
def regroup(t):
    areas = (
        t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("cents", F.round(F.col("c_acctbal") * 100).cast("bigint"))
    )
    out = official.regroup(areas, "r_name", ["cents"], ["cents"])
    return out.withColumn("avg_cents", F.round("avg_cents", 4))


@query(
    "count_bands",
    f"""WITH v AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey),
    b AS (SELECT CASE WHEN n <= 10 THEN '1-10' WHEN n <= 100 THEN '10-100' ELSE '>100' END AS band FROM v)
    SELECT band, count(*) AS regions, {sql_round('count(*) * 100.0 / (SELECT count(*) FROM b)')} AS share
    FROM b GROUP BY band""",
)
def count_bands(t):
    view = t.orders.groupBy("o_custkey").agg(F.count("*").alias("count"))
    return official.count_bands(view)


@query(
    "area_correlation",
    """WITH a AS (SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS cents
        FROM customer GROUP BY c_nationkey)
    SELECT round(corr(n, cents), 6) AS correlation, count(*) AS areas FROM a""",
)
def area_correlation(t):
    areas = t.customer.groupBy("c_nationkey").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("c_acctbal") * 100).cast("bigint")).alias("cents")
    )
    return official.area_correlation(areas, "n", "cents").withColumn("correlation", F.round("correlation", 6))


@query(
    "extremes",
    """WITH a AS (SELECT c_nationkey AS nation, count(*) AS n, max(c_acctbal) AS top FROM customer GROUP BY c_nationkey)
    SELECT 'n' AS metric, (SELECT min(nation) FROM a WHERE n = (SELECT max(n) FROM a)) AS highest,
    (SELECT CAST(max(n) AS DOUBLE) FROM a) AS highest_value, (SELECT min(nation) FROM a WHERE n = (SELECT min(n) FROM a)) AS lowest,
    (SELECT CAST(min(n) AS DOUBLE) FROM a) AS lowest_value
    UNION ALL SELECT 'top', (SELECT min(nation) FROM a WHERE top = (SELECT max(top) FROM a)), (SELECT max(top) FROM a),
    (SELECT min(nation) FROM a WHERE top = (SELECT min(top) FROM a)), (SELECT min(top) FROM a)""",
)
def extremes(t):
    areas = t.customer.groupBy(F.col("c_nationkey").alias("nation")).agg(
        F.count("*").cast("double").alias("n"), F.max("c_acctbal").alias("top")
    )
    return official.extremes(areas, "nation", ["n", "top"])


@query(
    "cleaning_report",
    f"""SELECT 'loaded' AS stage, count(*) AS "rows" FROM ({INCOME_SQL})
    UNION ALL SELECT 'remaining', count(*) FROM ({INCOME_SQL}) WHERE "median" IS NOT NULL""",
)
def cleaning_report(t):
    before = incomes(t).dropDuplicates()
    return official.cleaning_report(before, drop_any_null(before))


@query(
    "zero_fill_distinct",
    f"""SELECT DISTINCT " code", coalesce(" a", 0) AS " a", " c" FROM ({OFFENCE_ROWS})""",
)
def zero_fill_distinct(t):
    filled = fill_zero(offences(t), [" a", " b", " c"])
    return filled.select(" code", " a", " c").dropDuplicates()


@query(
    "compare_scenario",
    f"""WITH p AS (SELECT substr(sal, 4) AS sal, content, score FROM ({SQL_POSTS})),
    m AS (SELECT sal, CAST(sum(score) AS DOUBLE) / count(*) AS average FROM p
          WHERE {sql_mentions('content', TOPIC_WORDS['income'])} GROUP BY sal),
    o AS (SELECT CAST(c_nationkey AS VARCHAR) AS code, avg(c_acctbal) AS income FROM customer GROUP BY c_nationkey),
    j AS (SELECT {sql_round('average')} AS x, {sql_round('income')} AS y FROM m JOIN o ON sal = code)
    SELECT round(corr(x, y), 6) AS correlation, count(*) AS areas FROM j""",
)
def compare_scenario(t):
    posts = t.posts.withColumn("sal", F.substring("sal", 4, 10))
    metrics = topic_views(posts, {"income": TOPIC_WORDS["income"]}).select(
        F.col("sal").alias("code"), F.col("average_sentiment(income)").alias("x")
    )
    incomes_by_area = t.customer.groupBy(F.col("c_nationkey").cast("string").alias("code")).agg(
        (F.rint(F.avg("c_acctbal") * 100) / 100).alias("y")
    )
    out = official.compare_scenario(metrics.where("x IS NOT NULL"), incomes_by_area, "code", "x", "y")
    return out.withColumn("correlation", F.round("correlation", 6))
