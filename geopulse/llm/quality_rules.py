"""Quality rules: a table of thresholds compiled into one Spark projection.

All measures of a text come from its words and lines within its row, so the plan is a scan and a
projection without a shuffle, and nothing but Spark's functions runs. Repeated 8-word windows are found by
hashing each window and sorting the hashes (only of texts in which a hash occurs twice), so very long
and very repetitive texts cost n log n.

Results for edge cases: a null or empty text, or one without a word, has zero in all counts and fails
the base rules. A measure that would divide by zero is null, and a rule over a null measure does
not reject. Repeated rows give repeated results. Rows are judged one by one, so there are no ties.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.common import SPACE_CHARS, keyed_text, let, lower_ascii, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to is that was in it for on with as at by be this are or an from "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine "
    "de la le et les en un une du que est pour dans par au sur pas "
    "el y los del se las por para con no su al es"
).split()

# Measure, least value, greatest value (None: no bound). One repeated line of three is no junk.
RULES = (
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.1),
    ("letter_word_share", 0.7, None),
    ("n_stop_words", 1.0, None),
    ("dup_line_share", None, 0.5),
    ("ellipsis_line_share", None, 0.3),
    ("bullet_line_share", None, 0.9),
)


def char_count(text, chars: str):
    """How many characters of a text are among ``chars``."""
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def repeated_window_words(word, size=WINDOW):
    """Words in windows of ``size`` words that occur twice or more, the first included."""
    hashed = F.transform(word, lambda w: F.xxhash64(w))

    def windows(h):
        return F.transform(F.sequence(F.lit(1), F.size(h) - size + 1), lambda i: F.xxhash64(F.slice(h, i, size)))

    def covered(window):
        """Length of the union of the repeated windows' spans."""
        pairs = F.array_sort(F.transform(window, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(p):
            def same(x, k):
                before = F.get(p, k - 1)["h"] == x["h"]
                after = F.get(p, k + 1)["h"] == x["h"]
                return F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))

            return F.array_sort(F.transform(F.filter(p, same), lambda x: x["i"]))

        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
        return F.aggregate(
            let(pairs, repeated),
            start,
            lambda a, i: F.struct((a["n"] + (i + size - F.greatest(i, a["end"]))).cast("long").alias("n"), (i + size).alias("end")),
            lambda a: a["n"],
        )

    def count(window):
        return F.when(F.size(F.array_distinct(window)) == F.size(window), F.lit(0).cast("long")).otherwise(covered(window))

    found = let(hashed, lambda h: let(windows(h), count))
    return F.when(F.size(word) <= size, F.lit(0).cast("long")).otherwise(found)


def measures(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``doc_id``, the counts, and the ratios that rules look at, of every row."""
    text_col = F.col("text")
    has_word = F.filter(F.split(text_col, "\n"), lambda s: F.btrim(s, F.lit(SPACE_CHARS)) != "")
    rows = keyed_text(df, key, text).select("doc_id", "text", words(text_col).alias("words"), has_word.alias("lines"))
    n_words, n_lines = F.size("words").cast("long"), F.size("lines").cast("long")
    stop = F.lit(STOP_WORDS)
    counted = rows.select(
        "doc_id",
        n_words.alias("n_words"),
        (F.length("text") - char_count(text_col, SPACE_CHARS)).cast("long").alias("word_chars"),
        char_count(text_col, SYMBOLS).alias("n_symbols"),
        (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_window_words(F.col("words")).alias("n_repeat_words"),
        n_lines.alias("n_lines"),
        F.size(F.filter("words", lambda w: F.array_contains(stop, lower_ascii(w)))).cast("double").alias("n_stop_words"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
        F.size(F.filter("lines", lambda s: s.rlike(r"(\.\.\.|…)[ \t]*\z"))).alias("n_ellipsis"),
        F.size(F.filter("lines", lambda s: s.rlike(r"\A[ \t]*[-*•‣]"))).alias("n_bullets"),
    )

    def share(a, b):
        return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))

    return counted.withColumns(
        {
            "mean_word_chars": share("word_chars", "n_words"),
            "symbols_per_word": share("n_symbols", "n_words"),
            "letter_word_share": share("n_letter_words", "n_words"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "ellipsis_line_share": share("n_ellipsis", "n_lines"),
            "bullet_line_share": share("n_bullets", "n_lines"),
        }
    )


def compiled(rules=RULES):
    """The table of thresholds as one boolean column: no rule rejects."""
    verdict = F.lit(True)
    for measure, least, most in rules:
        value = F.col(measure)
        if least is not None:
            verdict = verdict & F.coalesce(value >= least, F.lit(True))
        if most is not None:
            verdict = verdict & F.coalesce(value <= most, F.lit(True))
    return verdict


def judge(df: DataFrame, key="doc_id", text="text", rules=RULES) -> DataFrame:
    """All measures of every row with ``base_failed`` and ``kept``."""
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measures(df, key, text).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & compiled(rules))
