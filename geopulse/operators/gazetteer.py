"""Building the gazetteer and resolving free-text places against it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.functions.lookup import MAX_LOOKUP_ROWS, Lookup, let
from geopulse.functions.text import name_bigrams, place_name
from geopulse.plans.skew import Dimension, lookup_join


def normalise_place_names(places: DataFrame) -> DataFrame:
    """Clean names; ``real_loc`` keeps the whole name when bigrams are added later."""
    return places.withColumn("location", place_name("location")).withColumn(
        "real_loc", F.col("location")
    )


def gazetteer_rows(places: DataFrame, order_col="ord") -> DataFrame:
    """Full names followed by the adjacent word pairs of names longer than two words.

    ``places`` has ``location, gcc, sal`` and an order column. The result keeps the order of a
    dictionary filled row by row: all full names first, then all pairs.
    """
    names = normalise_place_names(places)
    full = names.select(
        "location", "gcc", "sal", "real_loc",
        F.struct(F.lit(0).alias("part"), F.col(order_col).alias("doc"), F.lit(0).alias("at")).alias("ord"),
    )
    pairs = (
        names.withColumn("pairs", name_bigrams("location"))
        .na.drop("any", subset=["pairs", "gcc", "sal", "real_loc"])
        .select("gcc", "sal", "real_loc", order_col, F.posexplode("pairs").alias("at", "location"))
        .select(
            "location", "gcc", "sal", "real_loc",
            F.struct(F.lit(1).alias("part"), F.col(order_col).alias("doc"), F.col("at")).alias("ord"),
        )
    )
    return full.unionByName(pairs)


def last_wins(df: DataFrame, key, order_col) -> DataFrame:
    """For equal keys keep the last row; partial aggregation, so a hot key stays cheap."""
    rest = [c for c in df.columns if c != key]
    row = F.max_by(F.struct(*rest), F.col(order_col)).alias("row")
    return df.groupBy(key).agg(row).select(key, "row.*")


def build_gazetteer(places: DataFrame, order_col="ord") -> DataFrame:
    return last_wins(gazetteer_rows(places, order_col), "location", "ord")


# --- resolution ------------------------------------------------------------------------------
#
# Candidates of a place string are all its word subsequences, shortest first, then by position;
# the first one the gazetteer knows wins. A string of n words has 2^n - 1 candidates, so the
# search is turned round: a gazetteer name qualifies if its words are a subsequence of the place
# words, and the winner is the smallest (number of words, greedy leftmost positions).


def _anchored(gazetteer: DataFrame) -> DataFrame:
    """Gazetteer names grouped below their rarest word.

    Common words ("north", a state) then lead to few names, which keeps the fan-out of a
    frequent word small.
    """
    # What a gazetteer table may lack is NULL in the entry.
    more = [F.col(c) if c in gazetteer.columns else F.lit(None).cast("string").alias(c) for c in ("gcc", "real_loc")]
    names = gazetteer.where(F.col("sal") != "").select(
        "location", F.struct("sal", *more).alias("entry"), F.split("location", " ").alias("words")
    )
    each = names.select("location", "entry", "words", F.explode(F.array_distinct("words")).alias("anchor"))
    used = each.groupBy("anchor").agg(F.count("*").alias("used"))
    rarest = (
        each.join(used, "anchor")
        .groupBy("location")
        .agg(F.min(F.struct("used", "anchor", "words", "entry")).alias("r"))
        .select(
            F.col("r.anchor").alias("anchor"),
            F.struct(F.col("r.words").alias("words"), "location", F.col("r.entry").alias("entry")).alias("name"),
        )
    )
    return rarest


def _leftmost_positions(place_words: Column, name_words: Column) -> Column:
    """Greedy leftmost positions of the name words in the place words, NULL if out of order."""
    n = F.size(place_words)

    def step(found, word):
        start = F.coalesce(F.try_element_at(found, F.lit(-1)), F.lit(0))
        at = F.array_position(F.slice(place_words, start + 1, n), word).cast("int")
        return F.when(at > 0, F.concat(found, F.array(start + at)))

    return F.aggregate(name_words, F.array().cast("array<int>"), step)


def _hit(place_words: Column, name: Column) -> Column:
    return F.struct(
        F.size(name["words"]).alias("n"),
        _leftmost_positions(place_words, name["words"]).alias("at"),
        name["entry"]["sal"].alias("sal"),
        name["location"].alias("location"),
        name["entry"].alias("entry"),
    )


class PlaceResolver:
    """Resolves normalised place strings; built once per gazetteer."""

    def __init__(self, gazetteer: DataFrame, max_rows=MAX_LOOKUP_ROWS):
        self._dimension = Dimension(_anchored(gazetteer))
        self._names = self._dimension.frame
        # A bounded count first: the grouped form below is only built for a small gazetteer.
        self._lookup = None
        if self._names.limit(max_rows + 1).count() <= max_rows:
            grouped = self._names.groupBy("anchor").agg(F.collect_list("name").alias("names"))
            self._lookup = Lookup.from_frame(grouped, "anchor", "names", max_rows)

    @property
    def is_map_only(self) -> bool:
        return self._lookup is not None

    def best(self, place: Column) -> Column:
        """Struct ``(n, at, sal, location, entry)`` of the winner, or NULL. Needs a small gazetteer."""

        def search(words):
            names = F.flatten(
                F.transform(
                    F.array_distinct(words),
                    lambda w: F.coalesce(self._lookup.get(w), F.array().cast(self._names_type())),
                )
            )
            hits = F.transform(names, lambda name: _hit(words, name))
            return F.array_min(F.filter(hits, lambda h: h["at"].isNotNull()))

        return let(F.split(place, " "), search)

    def _names_type(self) -> str:
        return f"array<{self._names.schema['name'].dataType.simpleString()}>"

    def resolve(self, df: DataFrame, place: str, row_key, out="match") -> DataFrame:
        """Add the winner struct for the normalised place strings in column ``place``."""
        if self.is_map_only:
            return df.withColumn(out, self.best(F.col(place)))
        return self._resolve_by_join(df, place, row_key, out)

    def _resolve_by_join(self, df, place, row_key, out):
        """Large gazetteer: distinct places meet names through the anchor word."""
        distinct = df.where(F.col(place).isNotNull()).select(place).distinct()
        place_words = distinct.select(place, F.split(place, " ").alias("_words")).select(
            place, "_words", F.explode(F.array_distinct("_words")).alias("anchor")
        )
        pairs = self._dimension.joined(place_words, "anchor", [place, "anchor"], "inner")
        hits = pairs.select(place, _hit(F.col("_words"), F.col("name")).alias(out))
        best = hits.where(F.col(out)["at"].isNotNull()).groupBy(place).agg(F.min(out).alias(out))
        return lookup_join(df, best, place, row_key, "left")


def resolve_location(df, gazetteer, place, row_key, out="sal", keep_match=False, max_rows=MAX_LOOKUP_ROWS):
    """Region code of each normalised place string, NULL when no candidate is known.

    ``keep_match`` also adds ``possible_suburb``, a map from the matched name to its entry,
    empty when there is none.
    """
    resolver = gazetteer if isinstance(gazetteer, PlaceResolver) else PlaceResolver(gazetteer, max_rows)
    found = resolver.resolve(df, place, row_key, "_match")
    found = found.withColumn(out, F.col("_match.sal"))
    if keep_match:
        entry = F.create_map(F.col("_match.location"), F.col("_match.entry"))
        nothing = F.create_map().cast("map<string,struct<sal:string,gcc:string,real_loc:string>>")
        found = found.withColumn(
            "possible_suburb", F.when(F.col("_match").isNull(), nothing).otherwise(entry)
        )
    return found.drop("_match")
