"""Registered queries: a Spark callable each, and its SQL twin where SQL can say the same."""

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES = {}
ORACLES = {}


class Tables:
    """The given tables of one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self._dir = sf_dir.rstrip("/")

    def __getattr__(self, name) -> DataFrame:
        return self.spark.read.parquet(f"{self._dir}/{name}.parquet")

    @cached_property
    def posts(self) -> DataFrame:
        """Documents seen as stored posts: region from the source, a score from the length."""
        return self.documents.select(
            F.col("doc_id").cast("string").alias("tid"),
            F.col("source").alias("sal"),
            F.col("text").alias("content"),
            "lang",
            (F.col("n_chars") % 9 + 1).cast("int").alias("score"),
        )

    @cached_property
    def areas(self) -> DataFrame:
        """Nations as regions, with the world region as their state."""
        joined = self.nation.join(self.region, F.col("n_regionkey") == F.col("r_regionkey"))
        return joined.select(
            F.col("n_nationkey").cast("string").alias("code"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("state"),
        )


# The same two bindings for the SQL side.
SQL_POSTS = (
    "SELECT CAST(doc_id AS VARCHAR) AS tid, source AS sal, text AS content, lang, "
    "CAST(n_chars % 9 + 1 AS INTEGER) AS score FROM documents"
)
SQL_AREAS = (
    "SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name, r_name AS state "
    "FROM nation JOIN region ON n_regionkey = r_regionkey"
)


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def values_sql(rows, columns, name):
    """A literal table as a CTE."""
    body = ", ".join(
        "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows
    )
    return f"{name}({', '.join(columns)}) AS (VALUES {body})"


# --- text building blocks in SQL -------------------------------------------------------------
W = r"\p{L}\p{N}_"
S = r"\s\x0b\p{Z}\x1c-\x1f\x85"


def sql_strip(x):
    x = rf"regexp_replace({x}, '@[{W}]+[{S}]*', '', 'g')"
    x = rf"regexp_replace({x}, '#[{W}]+[{S}]*', '', 'g')"
    return rf"regexp_replace({x}, 'https?://[^{S}]+', '', 'g')"


def sql_place(x):
    from geopulse.constants import STATES

    x = rf"regexp_replace({x}, '[^{W}{S}]', '', 'g')"
    for name, short in STATES:
        x = f"replace({x}, '{name}', '{short}')"
    return f"regexp_replace({x}, ' +', ' ', 'g')"


def sql_tokens(x):
    x = rf"regexp_replace({x}, '(?i)n''t([^{W}]|$)', ' n''t\1', 'g')"
    x = rf"regexp_replace({x}, '(?i)''(s|m|d|ll|re|ve)([^{W}]|$)', ' ''\1\2', 'g')"
    return rf"regexp_extract_all({x}, 'n''t|''(?:s|m|d|ll|re|ve)|[{W}]+|[^{W}{S}]')"


def sql_bin(x):
    return (
        f"CAST(CASE WHEN {x} IS NULL THEN NULL WHEN {x} <= -0.8 THEN 1 WHEN {x} <= -0.6 THEN 2 "
        f"WHEN {x} <= -0.4 THEN 3 WHEN {x} <= -0.2 THEN 4 WHEN {x} < 0.2 THEN 5 WHEN {x} < 0.4 THEN 6 "
        f"WHEN {x} < 0.6 THEN 7 WHEN {x} < 0.8 THEN 8 ELSE 9 END AS INTEGER)"
    )


def sql_round(x):
    return f"round_even(({x}) * 100, 0) / 100"


def sql_mentions(x, words):
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


# --- model tables ----------------------------------------------------------------------------
# Small stand-ins made of words that occur in the given texts; the work is on the texts.
LEXICON = [
    ("the", 3), ("of", -4), ("and", 6), ("to", -5), ("is", 8), ("that", -9), ("was", -12),
    ("der", 4), ("die", -6), ("und", 7), ("von", -8), ("la", 5), ("le", -7), ("les", 9),
    ("que", -3), ("el", 6), ("et", -4), ("un", 10), ("with", 14), ("from", -11),
]
LEMMAS = [
    ("was", "be"), ("is", "be"), ("are", "be"), ("les", "le"), ("des", "de"), ("den", "der"),
    ("The", "the"), ("ands", "and"), ("thes", "the"), ("un", "une"), ("That", "that"), ("it", "it"),
]
TOPIC_WORDS = {"crime": ["thatin", "ononst", "der die"], "income": ["ation", "work", "que el"], "sentiment": None}


def literal_table(spark, rows, columns):
    """A small table the planner knows as a whole, so that using it takes no job."""
    body = ", ".join(str(row) for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def lexicon(spark):
    return literal_table(spark, LEXICON, ["token", "valence"])


def lemmas(spark):
    return literal_table(spark, LEMMAS, ["token", "lemma"])


SQL_LEXICON = values_sql(LEXICON, ["token", "valence"], "lexicon")
SQL_LEMMAS = values_sql(LEMMAS, ["token", "lemma"], "lemmas")


def sql_content(source, key, text):
    """CTE ``content(key, content)``: tokens replaced by lemmas and joined in order."""
    return f"""
    tok AS (SELECT {key}, unnest({sql_tokens(text)}) AS t,
                   generate_subscripts({sql_tokens(text)}, 1) AS pos FROM {source}),
    content AS (SELECT s.{key}, coalesce(j.content, '') AS content
                FROM {source} s LEFT JOIN (
                    SELECT {key}, string_agg(coalesce(lemma, t), ' ' ORDER BY pos) AS content
                    FROM tok LEFT JOIN lemmas ON t = token GROUP BY {key}) j ON s.{key} = j.{key})"""


def sql_compound(source, key, text="content"):
    """CTE ``polar(key, compound)`` from blank-separated tokens."""
    return f"""
    polar AS (SELECT s.{key}, s0 / sqrt(s0 * s0 + 15.0) AS compound FROM (
        SELECT d.{key}, CAST(coalesce(sum(valence), 0) AS DOUBLE) / 10 AS s0
        FROM (SELECT {key}, unnest(string_split(lower({text}), ' ')) AS w FROM {source}) d
        LEFT JOIN lexicon ON w = token GROUP BY d.{key}) s)"""


SQL_PROFILES = r"""
    lw AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS w FROM documents),
    lg AS (SELECT lang, substr('_' || w || '_', CAST(unnest(range(1, length(w) + 1)) AS INTEGER), 3) AS gram FROM lw),
    lc AS (SELECT lang, gram, count(*) AS n FROM lg GROUP BY lang, gram),
    profiles AS (SELECT lang, gram, CAST(301 - rk AS INTEGER) AS weight FROM (
        SELECT lang, gram, row_number() OVER (PARTITION BY lang ORDER BY n DESC, gram) AS rk FROM lc) WHERE rk <= 300)"""


def sql_detect(source, key, text):
    """CTE ``detected(key, lang)``."""
    return rf"""
    dw AS (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) AS w FROM {source}),
    dg AS (SELECT {key}, substr('_' || w || '_', CAST(unnest(range(1, length(w) + 1)) AS INTEGER), 3) AS gram FROM dw),
    ds AS (SELECT {key}, p.lang, sum(weight) AS s FROM dg JOIN profiles p ON dg.gram = p.gram GROUP BY {key}, p.lang),
    detected AS (SELECT {key}, lang FROM (
        SELECT {key}, lang, row_number() OVER (PARTITION BY {key} ORDER BY s DESC, lang) AS rk FROM ds) WHERE rk = 1)"""
