"""Lemmas by rule: endings are taken off, and what is left must be a word of a dictionary.

A token that has exceptions stands for itself and for them; of these only words of the dictionary count. Any
other token stands for itself and for every form that one rule makes of it; while none is a word, the rules are applied to
the forms again. The shortest word is the lemma; of equally short ones the token itself, then the first in
order. A token without any stays as it is.

A dictionary of checked size is a constant and the job is a projection; beyond that the distinct tokens that a rule or an
exception may change meet it in a join, which gives a lemma table. Both ways give the same.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.functions.lookup import MAX_LOOKUP_ROWS, Lookup
from geopulse.functions.text import tokenise
from geopulse.operators.sentiment import Normaliser

# Endings of English nouns and what takes their place.
NOUN_RULES = [
    ("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"),
]
FORM = "array<struct<level:int,form:string>>"


def endings(rules) -> str:
    return "(?:" + "|".join(sorted({ending for ending, _ in rules})) + r")\z"


def one_step(forms: Column, rules) -> Column:
    """What the rules make of some forms."""

    def made(form):
        return F.array(*[
            F.when(F.endswith(form, F.lit(old)), F.concat(F.substr(form, F.lit(1), F.length(form) - len(old)), F.lit(new)))
            for old, new in rules
        ])

    return F.array_distinct(F.filter(F.flatten(F.transform(forms, made)), lambda f: f.isNotNull()))


def candidates(token: Column, exceptions: Column, rules) -> Column:
    """All forms a token may stand for, with the level at which they count; 1 is the token's own."""
    itself = F.struct(F.lit(1).alias("level"), token.alias("form"))

    def step(state, level):
        forms = one_step(state["forms"], rules)
        found = F.transform(forms, lambda f: F.struct(level.cast("int").alias("level"), f.alias("form")))
        return F.struct(forms.alias("forms"), F.concat(state["all"], found).alias("all"))

    start = F.struct(F.array(token).alias("forms"), F.array(itself).cast(FORM).alias("all"))
    # A rule shortens a form, or makes one that no rule fits.
    levels = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(token)))
    by_rule = F.when(F.rlike(token, F.lit(endings(rules))), F.aggregate(levels, start, step)["all"]).otherwise(F.array(itself).cast(FORM))
    given = F.transform(exceptions, lambda f: F.struct(F.lit(1).alias("level"), f.alias("form")))
    return F.when(exceptions.isNull(), by_rule).otherwise(F.concat(F.array(itself).cast(FORM), given.cast(FORM)))


def order_of(candidate: Column, token: Column) -> Column:
    form = candidate["form"]
    return F.struct(candidate["level"].alias("level"), F.length(form).alias("size"), (form != token).alias("other"), form.alias("form"))


class RuleLemmatiser:
    """A normaliser for ingest: tokens as lemmas by rule, joined with blanks.

    ``dictionary`` has a column ``word``, ``exceptions`` (if any) ``token`` and ``lemma``, several rows for a
    token at will; both may repeat rows. They are read once, here.
    """

    def __init__(self, dictionary: DataFrame, exceptions: DataFrame = None, rules=NOUN_RULES, max_rows=MAX_LOOKUP_ROWS):
        self.rules, self.max_rows = rules, max_rows
        self._words = dictionary.select("word", F.lit(1).alias("known"))
        if exceptions is None:
            exceptions = dictionary.sparkSession.createDataFrame([], "token string, lemma string")
        lists = exceptions.where("token IS NOT NULL AND lemma IS NOT NULL").groupBy("token")
        self._exceptions = lists.agg(F.array_sort(F.collect_set("lemma")).alias("lemmas"))
        self._known = Lookup.from_frame(self._words, "word", "known", max_rows)
        self._given = Lookup.from_frame(self._exceptions, "token", "lemmas", max_rows) if self._known is not None else None

    @property
    def joins(self) -> bool:
        return self._known is None or self._given is None

    def lemma(self, token: Column) -> Column:
        """The lemma of a token; needs models of checked size."""
        forms = F.filter(candidates(token, self._given.get(token), self.rules), lambda c: self._known.get(c["form"]).isNotNull())
        best = F.array_min(F.transform(forms, lambda c: order_of(c, token)))["form"]
        return F.coalesce(best, token)

    def normalise(self, df: DataFrame, text, row_key, out="content") -> DataFrame:
        """Tokens of ``text`` as lemmas; NULL stays NULL. It goes row by row."""
        if not self.joins:
            return df.withColumn(out, F.array_join(F.transform(tokenise(text), self.lemma), " "))
        return Normaliser(self.lemma_table(df, text), self.max_rows).normalise(df, text, row_key, out)

    def lemma_table(self, df: DataFrame, text) -> DataFrame:
        """``token, lemma`` of the text's distinct tokens that have another lemma."""
        tokens = df.select(F.explode(tokenise(text)).alias("token")).distinct()
        tokens = tokens.join(self._exceptions, "token", "left")
        tokens = tokens.where(F.col("lemmas").isNotNull() | F.rlike("token", F.lit(endings(self.rules))))
        forms = tokens.select("token", F.explode(candidates(F.col("token"), F.col("lemmas"), self.rules)).alias("c"))
        known = forms.join(self._words.distinct(), F.col("c.form") == F.col("word"), "left_semi")
        best = known.groupBy("token").agg(F.min(order_of(F.col("c"), F.col("token"))).alias("best"))
        return best.select("token", F.col("best.form").alias("lemma")).where("token <> lemma")
