"""Language tagging with character-trigram profiles learned from a labelled table."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopulse.functions.lookup import MAX_LOOKUP_ROWS
from geopulse.functions.text import plain_words
from geopulse.plans.blocks import BLOCK, PLAIN, by_blocks
from geopulse.plans.skew import MAX_BROADCAST_ROWS, Dimension, fits

# Length of a language profile in the published n-gram method (fixed value, a parameter of train_lang).
PROFILE_SIZE = 300
BLANK = ord(" ")
CHUNK = 50_000


def word_trigrams(word):
    """Trigrams of a word padded with one underscore on each side."""
    padded = F.concat(F.lit("_"), word, F.lit("_"))
    return F.transform(
        F.sequence(F.lit(1), F.length(word)), lambda i: F.substring(padded, i, F.lit(3))
    )


def train_lang(df: DataFrame, text, lang, size=PROFILE_SIZE) -> DataFrame:
    """Profiles ``(lang, gram, weight)``: the most frequent trigram weighs ``size``, the next one less.

    Words are counted before they are cut into trigrams, so the shuffles carry vocabulary, not text.
    """
    counted = (
        df.where(F.col(lang).isNotNull())
        .select(F.col(lang).alias("lang"), F.explode(F.split(plain_words(text), " ")).alias("word"))
        .where("word <> ''")
        .groupBy("lang", "word")
        .agg(F.count("*").alias("n"))
    )
    grams = (
        counted.select("lang", "n", F.explode(word_trigrams(F.col("word"))).alias("gram"))
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return (
        grams.withColumn("rank", rank)
        .where(F.col("rank") <= size)
        .select("lang", "gram", (F.lit(size + 1) - F.col("rank")).cast("int").alias("weight"))
    )


def _scorer():
    """Function from a profile to a function from blank-separated lower-cased words to the best language.

    A profile is ``grams``, packed trigrams in order, and ``weights``, for each of them one weight per language.
    Many texts at a time are handled as one array of code points.
    """

    def scorer(grams, weights, langs):
        names = np.array([*langs, None], dtype=object)

        # Trigrams of ASCII characters stand in a table, the place of the others is searched.
        unknown, last = len(grams), (1 << 21) - 1
        a, b, c = grams >> 42, grams >> 21 & last, grams & last
        plain = np.flatnonzero((a | b | c) < 128)
        table = np.full(1 << 21, unknown, dtype=np.int32)
        table[(a << 14 | b << 7 | c)[plain]] = plain

        def place(points, middle):
            a, b, c = points[middle - 1], points[middle], points[middle + 1]
            odd = np.flatnonzero((a | b | c) > 127)
            at = table[(a << 14 | b << 7 | c) & last]
            if len(odd):
                packed = a[odd].astype(np.int64) << 42 | b[odd].astype(np.int64) << 21 | c[odd]
                found = np.minimum(np.searchsorted(grams, packed), unknown - 1)
                at[odd] = np.where(grams[found] == packed, found, unknown)
            return at

        def best_of(padded):
            ends = np.cumsum([len(text) for text in padded])
            points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
            # The middle of a trigram tells whose text it is; blanks have no middle.
            blank = points == BLANK
            middle = np.flatnonzero(~blank[1:-1]) + 1
            at = place(np.where(blank, np.int32(ord("_")), points), middle)
            # An unknown trigram weighs nothing.
            known = np.flatnonzero(at != unknown)
            until = np.searchsorted(middle[known], ends)
            upto = np.zeros((len(known) + 1, len(langs)), dtype=np.int64)
            np.cumsum(weights[at[known]], axis=0, out=upto[1:])
            totals = np.diff(upto[np.concatenate([[0], until])], axis=0)
            winner = totals.argmax(axis=1)
            winner[totals.max(axis=1) == 0] = len(langs)
            return names[winner]

        def best(texts):
            found, padded, size = [], [], 0
            for text in texts:
                padded.append(f" {text} " if text else "  ")
                size += len(padded[-1])
                # Arrays of this size stay in the processor cache.
                if size > CHUNK:
                    found.append(best_of(padded))
                    padded, size = [], 0
            if padded:
                found.append(best_of(padded))
            return np.concatenate(found) if found else np.array([], dtype=object)

        return best

    return scorer


def _compiler():
    """Function from profile rows to their scorer; None for no rows."""
    scorer = _scorer()

    def compile(profile: pd.DataFrame):
        if profile.empty:
            return None
        table = profile.pivot_table(
            index="gram", columns="lang", values="weight", aggfunc="sum", fill_value=0
        ).sort_index(axis=1)
        packed = np.array(
            [(ord(g[0]) << 42) | (ord(g[1]) << 21) | ord(g[2]) for g in table.index], dtype=np.int64
        )
        order = np.argsort(packed)
        weights = table.to_numpy(dtype=np.int64)[order]
        return scorer(packed[order], weights, list(table.columns))

    return compile


class LanguageDetector:
    """Picks the language whose profile weighs most over the trigrams of a text.

    Ties go to the first language by name; a text without known trigrams gets NULL.
    """

    def __init__(self, profiles: DataFrame, max_rows=MAX_LOOKUP_ROWS):
        profiles = Dimension(profiles.select("lang", "gram", "weight"), min(max_rows, MAX_BROADCAST_ROWS))
        self._profiles, self._score = profiles, None
        if fits(profiles.frame, max_rows):
            self._score = self._compile(profiles.frame.toPandas())

    @property
    def joins(self) -> bool:
        return self._score is None

    @staticmethod
    def _compile(profile: pd.DataFrame):
        best = _compiler()(profile)
        if best is None:
            return None

        def detected(texts: pd.Series) -> pd.Series:
            return pd.Series(best(texts), dtype=object)

        return F.pandas_udf(detected, "string")

    def detect(self, df: DataFrame, text, row_key, out="lang") -> DataFrame:
        plain = plain_words(text)
        if not self.joins:
            return df.withColumn(out, self._score(plain))
        compile = _compiler()

        def best(texts, part):
            score = compile(part.select(["lang", "gram", "weight"]).to_pandas())
            return [None] * len(texts) if score is None else list(score(texts))

        return by_blocks(df, plain, _grams, self._profiles, "gram", best, out, "string")


def _grams(blocks) -> DataFrame:
    """The trigrams of each block, from its distinct words; as rows, which is faster than arrays."""
    words = blocks.select(BLOCK, F.explode(F.split(PLAIN, " ")).alias("word")).where("word <> ''").distinct()
    padded = F.concat(F.lit("_"), "word", F.lit("_")).alias("padded")
    at = words.select(BLOCK, padded, F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    return at.select(BLOCK, F.substring("padded", F.col("at"), F.lit(3)).alias("gram"))


def detect_lang(df, text, profiles, row_key, out="lang", max_rows=MAX_LOOKUP_ROWS) -> DataFrame:
    return LanguageDetector(profiles, max_rows).detect(df, text, row_key, out)
