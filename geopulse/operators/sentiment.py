"""Normalised text, polarity and score distributions.

The models are tables: a lemma table (token, lemma) and a valence lexicon (token, valence in
integer tenths). Small ones become dictionaries in every task, large ones are joined block by block
(:mod:`geopulse.plans.blocks`). Either way the words of a text are looked up in Arrow batches.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.constants import SCORE_LABELS
from geopulse.functions import batches
from geopulse.functions.lookup import MAX_LOOKUP_ROWS, Lookup, let, unique_keys
from geopulse.functions.text import tokenise
from geopulse.plans.blocks import BLOCK, PLAIN, by_blocks, with_dictionary
from geopulse.plans.skew import MAX_BROADCAST_ROWS, Dimension

# Damping constant of the compound score (fixed value).
ALPHA = 15.0
# Exact integer arithmetic: valences and rule weights in 1e-8 units.
UNIT = 100_000_000
# Fixed values of the rules: booster strength, its fade over distance, negation factor.
BOOST_MICRO = [293_000, 278_350, 263_700]
# Negation factor -0.74 to the power 0..3, as integers over NEGATION_SCALE.
NEGATION_SCALE = 1_000_000
NEGATION_FACTORS = [1_000_000, -740_000, 547_600, -405_224]
NEGATES = 2
NEGATORS = ["not", "n't", "no", "never", "none", "nor", "neither", "nothing", "without", "cannot"]
BOOSTERS = {
    "very": 1, "really": 1, "extremely": 1, "so": 1, "totally": 1, "most": 1,
    "barely": -1, "hardly": -1, "scarcely": -1, "slightly": -1, "somewhat": -1,
}


class Normaliser:
    """Tokens replaced by their lemma. The lemma table is measured and read once, here.

    The result is the same for lemma tables of any size. Of several lemmas of a token the least counts.
    """

    def __init__(self, lemmas: DataFrame, max_rows=MAX_LOOKUP_ROWS):
        self._table, self._dimension = Lookup.from_frame(lemmas, "token", "lemma", max_rows), None
        if self._table is None:
            lemmas = unique_keys(lemmas, "token", "lemma")
            self._dimension = Dimension(lemmas, min(max_rows, MAX_BROADCAST_ROWS))

    @property
    def joins(self) -> bool:
        return self._table is None

    def blanks(self) -> bool:
        """Whether a lemma is blank."""
        if self.joins:
            return not self._dimension.frame.where("trim(lemma) = ''").isEmpty()
        return any(not lemma.strip(" ") for lemma in self._table.mapping().values())

    def normalise(self, df, text, row_key, out="content") -> DataFrame:
        """Tokens of ``text`` as lemmas, joined with blanks; NULL stays NULL. It goes row by row: a
        ``row_key`` that repeats does no harm."""
        # No token has a blank.
        plain = F.array_join(tokenise(text), " ")
        if self.joins:
            work = with_dictionary(batches.replaced(), "token", "lemma")
            return by_blocks(df, plain, _tokens, self._dimension, "token", work, out, "string")
        return df.withColumn(out, batches.by_dictionary(batches.replaced(), self._table.mapping(), "string")(plain))


def _tokens(blocks) -> DataFrame:
    return blocks.select(BLOCK, F.explode(F.split(PLAIN, " ")).alias("token"))


def normalise_text(df, text, lemmas, row_key, out="content", max_rows=MAX_LOOKUP_ROWS) -> DataFrame:
    """One use of a :class:`Normaliser`."""
    return Normaliser(lemmas, max_rows).normalise(df, text, row_key, out)


def compound(total) -> Column:
    """Valence sum (plain units) squashed into -1..1."""
    return total / F.sqrt(total * total + F.lit(ALPHA))


class Scorer:
    """Compound score of blank-separated tokens. The lexicon is measured and read once, here.

    The valences are summed as integers, so the sum does not depend on the order of the rows.
    With ``rules`` a booster up to three tokens ahead strengthens or weakens a valence, and a
    negator up to three tokens ahead flips and damps it. The result is the same for lexicons of any
    size; of several valences of a token the least counts.
    """

    def __init__(self, lexicon: DataFrame, rules=False, max_rows=MAX_LOOKUP_ROWS):
        self._rules = rules
        self._table, self._dimension = Lookup.from_frame(lexicon, "token", "valence", max_rows), None
        if self._table is None:
            lexicon = unique_keys(lexicon, "token", "valence")
            self._dimension = Dimension(lexicon, min(max_rows, MAX_BROADCAST_ROWS))

    @property
    def joins(self) -> bool:
        return self._table is None

    def score(self, df, text, row_key, out="compound") -> DataFrame:
        """Adds the score, row by row; a post without text gets NULL."""
        plain = F.lower(F.col(text))
        work = _rule_sums() if self._rules else batches.sums()
        if self.joins:
            # Sums without rules keep the kind of the valences.
            work, kind = with_dictionary(work, "token", "valence"), "bigint" if self._rules else "double"
            scored = by_blocks(df, plain, _tokens, self._dimension, "token", work, TOTAL, kind)
        else:
            table = {token: int(valence) for token, valence in self._table.mapping().items()}
            scored = df.withColumn(TOTAL, batches.by_dictionary(work, table, "bigint")(plain))
        return scored.withColumn(out, compound(F.col(TOTAL).cast("double") / (UNIT if self._rules else 10))).drop(TOTAL)


TOTAL = "_total"


def _rule_sums():
    return batches.rule_sums(_parts(), NEGATES, BOOST_MICRO, NEGATION_FACTORS, NEGATION_SCALE, UNIT)


def _parts() -> dict:
    """Words with a part in the rules."""
    return {**BOOSTERS, **dict.fromkeys(NEGATORS, NEGATES)}


def polarity(df, text, lexicon, row_key, out="compound", rules=False, max_rows=MAX_LOOKUP_ROWS):
    """One use of a :class:`Scorer`."""
    return Scorer(lexicon, rules, max_rows).score(df, text, row_key, out)


# --- the whole score -----------------------------------------------------------------------------
# What capitals add, and their fade over distance; what a contrast does to the words before and
# after it, in tenths; what exclamation and question marks add to a text.
CAPITALS_MICRO = [733_000, 696_350, 659_700]
CONTRAST, BEFORE, AFTER = "but", 5, 15
EXCLAMATION_MICRO, MOST_EXCLAMATIONS = 292_000, 4
QUESTION_MICRO, MOST_QUESTIONS, MANY_QUESTIONS_MICRO = 180_000, 3, 960_000
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


WHITE = r"[ \t\n\x0B\f\r]+"
WHOLE_SCORE = {
    "punctuation": PUNCTUATION, "negates": NEGATES, "contrast": CONTRAST, "before": BEFORE, "after": AFTER, "boosts": BOOST_MICRO,
    "capitals": CAPITALS_MICRO, "unit": UNIT, "scale": NEGATION_SCALE, "factors": NEGATION_FACTORS,
}


def bare(word) -> Column:
    """A word without punctuation around it if more than two characters are left."""
    return let(F.btrim(word, F.lit(PUNCTUATION)), lambda b: F.when(F.length(b) > 2, b).otherwise(F.col(word)))


class Phrases:
    """Valences of phrases of several words, as a trie: every beginning of a phrase leads to what it is worth, if
    anything, and to nothing else. A phrase list is small; one beyond the size of a lookup is refused."""

    def __init__(self, phrases: DataFrame, max_rows=MAX_LOOKUP_ROWS):
        words = F.split(F.lower(F.trim("phrase")), " +")
        listed = phrases.where("phrase IS NOT NULL AND valence IS NOT NULL").select(words.alias("w"), "valence")
        starts = listed.select("w", "valence", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("k"))
        start = F.array_join(F.slice("w", 1, F.col("k")), " ").alias("start")
        worth = F.min(F.when(F.col("k") == F.size("w"), F.col("valence").cast("bigint")))
        nodes = starts.groupBy(start).agg(F.struct(worth.alias("v")).alias("node"))
        self._trie = Lookup.from_frame(nodes, "start", "node", max_rows)
        if self._trie is None:
            raise ValueError("the phrase list is too large")
        self.longest = listed.agg(F.max(F.size("w"))).first()[0] or 0

    def trie(self) -> dict:
        """Every beginning of a phrase with its valence; None where no phrase ends."""
        return {path: node.get("v") for path, node in self._trie.mapping().items()}


class FullScorer:
    """Compound score with boosters, negation, contrast, capitals, punctuation and phrases.

    Words are cut at white space. A word's valence is that of its lower-case form. On top of the rules of
    :class:`Scorer`: a word in capitals, in a text that is not all in capitals, counts for more, and so does
    a booster in capitals; what stands before the first ``but`` counts half, what comes after it half as much again;
    exclamation and question marks strengthen the sum. A phrase counts as one word where it begins; its words have no valence
    and no part in the rules of their own, and a phrase that begins inside of another does not count.

    The result is the same for lexicons of any size and does not depend on the order of rows. A post without text
    gets NULL.
    """

    def __init__(self, lexicon: DataFrame, phrases: DataFrame = None, max_rows=MAX_LOOKUP_ROWS):
        self._phrases = None if phrases is None else Phrases(phrases)
        self._table, self._dimension = Lookup.from_frame(lexicon, "token", "valence", max_rows), None
        if self._table is None:
            self._dimension = Dimension(unique_keys(lexicon, "token", "valence"), min(max_rows, MAX_BROADCAST_ROWS))

    @property
    def joins(self) -> bool:
        return self._table is None

    def score(self, df, text, row_key, out="compound") -> DataFrame:
        trie, longest = (self._phrases.trie(), self._phrases.longest) if self._phrases is not None else ({}, 0)
        work = batches.whole_sums(WHOLE_SCORE | {"parts": _parts()}, trie, longest)
        if self.joins:
            work = with_dictionary(work, "token", "valence")
            scored = by_blocks(df, F.col(text), self._words, self._dimension, "token", work, TOTAL, "bigint")
        else:
            scored = df.withColumn(TOTAL, batches.by_dictionary(work, self._table.mapping(), "bigint")(F.col(text)))
        total = F.col(TOTAL).cast("double") / (10 * UNIT)
        scored = scored.withColumn(TOTAL, total + F.signum(total) * self._emphasis(F.col(text)))
        return scored.withColumn(out, compound(F.col(TOTAL))).drop(TOTAL)

    @staticmethod
    def _words(blocks) -> DataFrame:
        """Lower-case words of each block; what a word looks like is found out once for each."""
        raw = blocks.select(BLOCK, F.explode(F.split(PLAIN, WHITE)).alias("raw")).distinct()
        return raw.select(BLOCK, F.lower(bare("raw")).alias("token"))

    @staticmethod
    def _emphasis(text):
        def count(mark):
            return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

        shouted = F.least(count("!"), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION_MICRO
        asked = let(count("?"), lambda n: F.when(n < 2, 0).when(n <= MOST_QUESTIONS, n * QUESTION_MICRO).otherwise(MANY_QUESTIONS_MICRO))
        return (shouted + asked) / 1_000_000.0


def score_histogram(df: DataFrame, score="score", count=None, by=()) -> DataFrame:
    """Posts per score, with zero for scores that do not occur.

    ``count`` names a column of counts when ``df`` is a view instead of posts.
    """
    n = F.sum(count) if count else F.count("*")
    counted = df.groupBy(*by, F.col(score).cast("int").alias("score")).agg(n.alias("_n"))
    # Nine counters per group in one pass, then turned into rows.
    wide = counted.groupBy(*by).agg(
        *[F.sum(F.when(F.col("score") == s, F.col("_n")).otherwise(0)).alias(str(s)) for s in SCORE_LABELS]
    )
    long = wide.unpivot(list(by), [str(s) for s in SCORE_LABELS], "score", "count")
    return long.select(
        *by, F.col("score").cast("int").alias("score"), F.coalesce("count", F.lit(0)).cast("bigint").alias("count")
    )
