"""The operators' registered queries: each over its whole table, with production parameters."""

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.llm import (
    block_mix, byte_bpe, host_paths, interpolated_lm, lang_conv, license_rules, line_dedup, merkle, quality_rules,
    scaled_sketch, simhash_trees, token_alignment, token_store,
)
from geopulse.llm.common import doc_fold, table

QUERIES = {}
ORACLES = {}

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as an installed
    package would be."""
    path = spark.sparkContext.environment.setdefault("PYTHONPATH", ROOT)
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([path, ROOT])


def query(name, source="documents", sql=None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(table(spark, sf_dir, source))

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query("op2_line_dedup")
def line_dedup_query(docs):
    return line_dedup.report(docs)


@query("op3_host_paths", "pages")
def host_paths_query(pages):
    return host_paths.extract(pages)


def quality_sql():
    """The same measures and thresholds in SQL."""
    blank = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
    stop = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    rules = []
    for measure, least, most in quality_rules.RULES:
        rules += [f"coalesce({measure} >= {least}, true)"] if least is not None else []
        rules += [f"coalesce({measure} <= {most}, true)"] if most is not None else []
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
    t AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^ 	-
]+') AS w,
                 list_filter(string_split(text, chr(10)), lambda s: trim(s, {blank}) <> '') AS l FROM d),
    win AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS s
            FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM t)),
    twice AS (SELECT rid, s FROM win GROUP BY rid, s HAVING count(*) > 1),
    covered AS (SELECT rid, count(DISTINCT p) AS n
                FROM (SELECT win.rid, unnest(range(win.i, win.i + 8)) AS p
                      FROM win JOIN twice ON win.rid = twice.rid AND win.s = twice.s) GROUP BY rid),
    m AS (SELECT doc_id, len(w) AS n_words, len(l) AS n_lines,
                 coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                 (length(text) - length(translate(text, '{quality_rules.SYMBOLS}', ''))) AS n_symbols,
                 len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
                 len(list_filter(w, lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
                                              IN ({stop}))) AS n_stop_words,
                 len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter_words,
                 len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[ 	]*\z'))) AS n_ellipsis,
                 len(list_filter(l, lambda x: regexp_matches(x, '\A[ 	]*[-*•‣]'))) AS n_bullets
          FROM t LEFT JOIN covered ON t.rid = covered.rid),
    r AS (SELECT *, word_chars::DOUBLE / nullif(n_words, 0) AS mean_word_chars,
                 n_symbols::DOUBLE / nullif(n_words, 0) AS symbols_per_word,
                 n_letter_words::DOUBLE / nullif(n_words, 0) AS letter_word_share,
                 n_dup_lines::DOUBLE / nullif(n_lines, 0) AS dup_line_share,
                 n_ellipsis::DOUBLE / nullif(n_lines, 0) AS ellipsis_line_share,
                 n_bullets::DOUBLE / nullif(n_lines, 0) AS bullet_line_share,
                 n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND {' AND '.join(rules)} AS kept FROM r"""


@query("op4_quality_rules", sql=quality_sql())
def quality_rules_query(docs):
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality_rules.judge(docs).select(columns)


@query("op5_scaled_sketch")
def scaled_sketch_query(docs):
    return scaled_sketch.compare_edited(docs)


@query("op6_license_rules")
def license_rules_query(docs):
    found = license_rules.scan(docs)
    base, more = F.col("base"), F.col("detections")

    def labels(*lists):
        return F.array_join(F.array_sort(F.array_distinct(F.concat(*[l["label"] for l in lists]))), ",")

    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["first"]).alias("first_word"),
        F.array_max(base["first"]).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(base, more).alias("labels"),
        F.coalesce(F.array_max(F.concat(base["weight"], more["weight"])), F.lit(0.0)).alias("score"),
    )


@query("op7_simhash_trees")
def simhash_trees_query(docs):
    found = simhash_trees.near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op8_byte_bpe")
def byte_bpe_query(docs):
    return byte_bpe.round_trip(docs, *byte_bpe.vocabulary())


@query("op9_lang_conv")
def lang_conv_query(docs):
    fold = doc_fold("doc_id", 4)
    net = lang_conv.train(docs.where(fold != 2))
    docs = docs.select("doc_id", "text", F.coalesce(fold == 2, F.lit(False)).alias("held_out"))
    return lang_conv.predict(docs, net, keep=["held_out"]).select(
        "doc_id", F.col("kept_held_out").alias("held_out"), "lang_pred", "score"
    )


@query("op1_block_mix")
def block_mix_query(docs):
    return block_mix.mix(docs)


@query("op10_interpolated_lm")
def interpolated_lm_query(docs):
    fold = doc_fold("doc_id", 5)
    found = interpolated_lm.score(docs, F.coalesce(fold != 1, F.lit(False)))
    held_out = F.coalesce(fold == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held_out, "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op11_galloping_alignment")
def token_alignment_query(docs):
    return token_alignment.report(docs, *token_alignment.vocabularies())


@query("op12_orc_tokens")
def token_store_query(docs):
    return token_store.written_and_read(docs, token_store.vocabulary())


@query("op13_merkle_manifest")
def merkle_query(docs):
    changed = [F.translate(f, "\n", "") if f == "text" else F.col(f) for f in merkle.FIELDS]
    claim = F.when(doc_fold("doc_id", 2) == 0, merkle.leaf(changed))
    found = merkle.manifest(docs, keep={"claim": claim})
    found = merkle.folded(found.withColumn("claim", F.coalesce("claim", "leaf")), "claim")
    siblings = F.translate("proof", ",;", "")
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.digest(siblings).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
