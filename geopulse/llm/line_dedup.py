"""Line deduplication by an exact set-similarity join.

A line (text between line feeds) is the set of its lower-cased words. It goes if an earlier line, in order of
document key, line number and line hash, has Jaccard similarity 0.8 or more with it, whether or not that
one stays. Words stand as 64-bit hashes, lines as 64-bit hashes of their text.

1. Equal lines are one class; only the first of a class meets other classes.
2. The words of a line are ordered by rarity. Rarity is a count over the whole corpus in ``BUCKETS``
   hashed counters, a table of fixed size that goes to all tasks; any order is right, rarity makes it cheap.
3. Two lines that are similar share a word among the first ``n - ceil(0.8 n) + 1`` of each (prefix filter).
   Lines meet at those words, and a pair goes on if its lengths (length filter), the places of the word
   (positional filter) and the parity bits of the two sets (a lower bound of their difference) allow it.
4. The word sets of pairs that are left are fetched and compared.

Groups of many near copies would meet in step 3 in all pairs. So before it lines meet the first line
of each large bucket of a few bottom-hash signatures; those found similar to it are done, and only
lines not done look for earlier ones in step 3. This changes the work, not the result.

Results for edge cases: a null text gives no lines and stays null. A line without a word is never
removed. Lines of one to three distinct words go only after an equal set of words. Documents are one and the same if key
and text are (repeated rows lose the same lines). A null key comes first. Very long lines and texts are
whole. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.common import SPACE_CHARS, free, let, written

SPACES = r"[\x20\x09-\x0D]+"
BUCKETS = 1 << 16
HASH_BITS = (1 << 56) - 1
LARGE = 16
FILTER_BITS = 1 << 20


def lines_of(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``doc_id, doc_hash, line_no, line, line_hash`` of each line with a word; ``line`` is lower-cased."""
    docs = df.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("doc_hash"), F.col(text).alias("text"))
    lines = docs.select("doc_id", "doc_hash", F.posexplode(F.split(F.lower("text"), "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(SPACE_CHARS))).where("line <> ''")
    return lines.withColumn("line_hash", F.xxhash64("line"))


def word_array(text, others=("\t", "\x0b", "\x0c", "\r", "  ")):
    """Words between single blanks; other white space becomes a blank first, where there is any."""
    odd = F.lit(False)
    for c in others:
        odd = odd | F.contains(text, F.lit(c))
    # One plain character is cut at much faster than a pattern.
    return F.split(F.when(odd, F.regexp_replace(text, SPACES, " ")).otherwise(text), " ")


def word_hashes(line):
    """Hashes of the distinct words of a line that has one and no white space around it."""
    return F.array_distinct(F.transform(word_array(line), lambda w: F.xxhash64(w)))


def literal_numbers(values, kind):
    """A list of numbers as a constant the optimizer folds into one array."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def rarity(df: DataFrame, text="text"):
    """A constant array of ``BUCKETS`` classes: three times the logarithm of how many words fall there."""
    # Text before the first word or after the last gives an empty word, which counts for nothing. Arrays of the words of
    # a line are cut and taken apart in half the time that those of whole texts take.
    line = df.select(F.explode(F.split(F.lower(F.col(text)), "\n")).alias("line"))
    word = line.select(F.explode(word_array(F.col("line"))).alias("word"))
    bucket = F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")
    counts = word.groupBy(bucket).count()
    classes = [0] * BUCKETS
    for b, level in counts.select("bucket", F.floor(3 * F.log2(F.col("count") + 1)).cast("int")).collect():
        classes[b] = level
    # Small numbers: the driver holds this constant once for each plan that names it.
    return literal_numbers(classes, "bigint")


def bits_of(hashes):
    """64 parity bits of a set: bit i is the parity of how many members name it."""

    def flip(acc, h):
        return acc.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), h.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(hashes, F.lit(0).cast("bigint"), flip)


def signatures(prefix):
    """A few hashes that two similar sets share with high probability: neighbours among the least of
    their rarest words, in two orders that have nothing to do with rarity."""

    def chained(order):
        low = F.slice(F.sort_array(order), 1, 4)
        return let(low, lambda b: F.array(*[F.xxhash64(F.get(b, i), F.get(b, i + 1)) for i in range(3)]))

    return F.concat(chained(prefix), chained(F.transform(prefix, lambda h: F.xxhash64(h))))


def line_sets(df: DataFrame, levels, key="doc_id", text="text") -> DataFrame:
    """One row for each class of equal lines: ``line_hash``, its first place (``doc_id, line_no, doc_hash``),
    ``n`` words, the ``prefix`` in order of rarity, and ``bits0, bits1``."""
    lines = lines_of(df, key, text)
    lines = lines.select("doc_id", "line_no", "doc_hash", "line_hash", word_hashes(F.col("line")).alias("h"))

    def ranked(h):
        level = F.get(levels, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
        return F.shiftleft(level, 56).bitwiseOR(h.bitwiseAND(F.lit(HASH_BITS)))

    n = F.size("h")
    # At three words or fewer only equal sets are similar, and one word of them finds those.
    length = F.when(n < 4, F.lit(1)).otherwise(n - F.expr("(4 * size(h) + 4) div 5").cast("int") + 1)
    prefix = F.transform(F.slice(F.sort_array(F.transform("h", ranked)), 1, length), lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"))
    rows = lines.select(
        "line_hash",
        F.struct("doc_id", "line_no", "doc_hash").alias("place"),
        n.alias("n"),
        prefix.alias("prefix"),
        # 128 bits, half of them for hashes below zero. Two sets differ in at least as many words as bits.
        bits_of(F.filter("h", lambda x: x < 0)).alias("bits0"),
        bits_of(F.filter("h", lambda x: x >= 0)).alias("bits1"),
    )
    same = [F.first(c).alias(c) for c in ("n", "prefix", "bits0", "bits1")]
    sets = rows.groupBy("line_hash").agg(F.min("place").alias("place"), *same)
    return sets.select("line_hash", "place.*", "n", "prefix", "bits0", "bits1")


def may_match(a: str, b: str):
    """Whether lengths and parity bits leave room for similarity 0.8 (4/9 of the sum in common)."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (5 * F.least(na, nb) >= 4 * F.greatest(na, nb)) & (bits_apart(a, b) <= na + nb - 2 * common_of(na, nb))


def bits_apart(a: str, b: str):
    """In how many words two sets differ at least."""
    apart = [F.bit_count(F.col(f"{a}.bits{i}").bitwiseXOR(F.col(f"{b}.bits{i}"))) for i in (0, 1)]
    return apart[0] + apart[1]


def common_of(na, nb):
    """How many words sets of these sizes have in common at least if they are similar."""
    return F.floor((4 * (na + nb) + 8) / 9)


def later(a: str, b: str):
    """Whether a stands after b."""
    return F.struct(f"{a}.doc_id", f"{a}.line_no", f"{a}.line_hash") > F.struct(f"{b}.doc_id", f"{b}.line_no", f"{b}.line_hash")


SHORT = ["line_hash", "doc_id", "line_no", "n", "bits0", "bits1"]


def pairs_with_first(sets: DataFrame):
    """Pairs ``line_hash, earlier`` of lines with the first line of their large buckets, and the table they read."""
    signed = sets.where("n >= 4").select(*SHORT, F.explode(signatures(F.col("prefix"))).alias("sign"))
    large = signed.groupBy("sign").count().where(F.col("count") >= LARGE).select("sign")
    large = written(large, "line-signs")
    buckets = signed = written(signed.join(large, "sign"), "line-buckets")
    free(large)
    hubs = signed.groupBy("sign").agg(F.min(F.struct("doc_id", "line_no", "line_hash", "n", "bits0", "bits1")).alias("hub"))
    hubs = hubs.select("sign", "hub.*")
    fits = may_match("a", "b")
    joined = signed.alias("a").join(hubs.alias("b"), (F.col("a.sign") == F.col("b.sign")) & later("a", "b") & fits)
    return joined.select("a.line_hash", F.col("b.line_hash").alias("earlier")).distinct(), buckets


def pairs_by_prefix(sets: DataFrame) -> DataFrame:
    """Pairs ``line_hash, earlier`` of lines not ``done`` with earlier ones that the filters let through.

    Each posting is a token and what the filters need. Both sides of the join are the same postings, shuffled
    once: every condition speaks of both sides, so none moves below the exchange. Which line of a pair stands later
    is asked of the few pairs that are left, so postings do not carry places.
    """
    posted = sets.select("line_hash", "n", "bits0", "bits1", "done", F.posexplode("prefix").alias("pos", "token"))
    # Length and place share a number with the mark.
    n, pos, done = F.col("n").cast("bigint"), F.col("pos").cast("bigint"), F.col("done").cast("bigint")
    meta = F.shiftleft(n, 32).bitwiseOR(F.shiftleft(pos, 1)).bitwiseOR(done).alias("meta")
    posted = posted.select("token", "line_hash", meta, "bits0", "bits1")
    (na, pa, da), (nb, pb, db) = [
        (F.shiftright(m, 32), F.shiftright(m.bitwiseAND(F.lit(0xFFFFFFFF)), 1), m.bitwiseAND(F.lit(1))) for m in (F.col("a.meta"), F.col("b.meta"))
    ]
    needed = common_of(na, nb)
    ahead, behind = F.least(pa, pb) + 1, F.least(na - pa, nb - pb) - 1
    # Most pairs go by their parity bits.
    same = (
        (F.col("a.token") == F.col("b.token"))
        & (F.col("a.line_hash") < F.col("b.line_hash"))
        & (bits_apart("a", "b") <= na + nb - 2 * needed)
        & (5 * F.least(na, nb) >= 4 * F.greatest(na, nb))
        & (ahead + behind >= needed)
        & (da.bitwiseAND(db) == 0)
    )
    met = posted.alias("a").join(posted.alias("b"), same).select(F.col("a.line_hash").alias("x"), F.col("b.line_hash").alias("y"))
    met, place = met.distinct(), sets.select("line_hash", "doc_id", "line_no", "done")
    met = met.join(place.alias("a"), F.col("x") == F.col("a.line_hash")).join(place.alias("b"), F.col("y") == F.col("b.line_hash"))
    late = later("a", "b")
    return met.where(~F.when(late, F.col("a.done")).otherwise(F.col("b.done"))).select(
        F.when(late, F.col("x")).otherwise(F.col("y")).alias("line_hash"),
        F.when(late, F.col("y")).otherwise(F.col("x")).alias("earlier"),
    )


def bit_filter(keys: DataFrame, column: str):
    """A test of fixed size that all values of ``column`` pass, and few others while they are few: a function that takes
    rows and a value of theirs, and gives the rows that pass or, with ``passing=False``, the others."""
    place = F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))
    word = keys.select(F.shiftright(place, 6).cast("int").alias("_word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    # At most FILTER_BITS / 64 rows, which meet the others as a table: as a constant they would stand in every plan.
    table = F.broadcast(word.groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("_bits")))

    def rows(df, value, passing=True):
        at = F.pmod(F.xxhash64(value), F.lit(FILTER_BITS))
        shifted = F.call_function("shiftright", table["_bits"], at.bitwiseAND(F.lit(63)).cast("int"))
        hit = (F.shiftright(at, 6).cast("int") == table["_word"]) & (shifted.bitwiseAND(F.lit(1)) == 1)
        return df.join(table, hit, "left_semi" if passing else "left_anti")

    return rows


def similar(df: DataFrame, sets: DataFrame, pairs: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``line_hash`` of the later lines of pairs whose word sets have Jaccard similarity 0.8 or more.

    Words are fetched from the documents where the lines stand first.
    """
    needed = pairs.select("line_hash").unionByName(pairs.select(F.col("earlier").alias("line_hash"))).distinct()
    needed = written(needed.join(sets.select("line_hash", "doc_id", "line_no", "doc_hash"), "line_hash"), "line-needed")
    lines = lines_of(bit_filter(needed, "doc_hash")(df, F.xxhash64(F.col(text))), key, text)
    at = F.expr("l.line_hash = w.line_hash AND l.line_no = w.line_no AND l.doc_hash = w.doc_hash AND l.doc_id <=> w.doc_id")
    found = lines.alias("l").join(needed.alias("w"), at, "left_semi").groupBy("line_hash").agg(F.first("line").alias("line"))
    words_of = written(found.select("line_hash", word_hashes(F.col("line")).alias("h")), "line-words")
    both = pairs.join(words_of, "line_hash").withColumnRenamed("h", "x")
    both = both.join(words_of.select(F.col("line_hash").alias("earlier"), F.col("h").alias("y")), "earlier")
    common = F.size(F.array_intersect("x", "y"))
    both = both.where(9 * common >= 4 * (F.size("x") + F.size("y"))).select("line_hash").distinct()
    both = written(both, "line-similar")
    free(needed, words_of)
    return both


def removed_lines(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``doc_id, doc_hash, removed``: the line numbers (from 0, in order) that a document loses."""
    sets = written(line_sets(df, rarity(df, text), key, text), "line-sets")
    pairs, buckets = pairs_with_first(sets)
    pairs = written(pairs, "line-pairs")
    free(buckets)
    first = similar(df, sets, pairs, key, text)
    free(pairs)
    done = sets.join(first.withColumn("done", F.lit(True)), "line_hash", "left").withColumn("done", F.coalesce("done", F.lit(False)))
    pairs = written(pairs_by_prefix(done), "line-pairs")
    rest = similar(df, sets, pairs, key, text)
    free(pairs)
    near = first.unionByName(rest).distinct().withColumn("near", F.lit(True))
    classes = sets.select("line_hash", F.struct("doc_id", "line_no", "doc_hash").alias("place")).join(near, "line_hash", "left")
    lines = lines_of(df, key, text).select("doc_id", "line_no", "doc_hash", "line_hash")
    gone = lines.join(classes, "line_hash").where(
        F.col("near").isNotNull() | ~F.struct("doc_id", "line_no", "doc_hash").eqNullSafe(F.col("place"))
    )
    gone = written(gone.groupBy("doc_id", "doc_hash").agg(F.sort_array(F.collect_set("line_no")).alias("removed")), "removed-lines")
    free(sets, first, rest)
    return gone


def report(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """Per document ``doc_id, n_lines, n_removed, removed``: every row, also those that lose nothing."""
    gone = removed_lines(df, key, text)
    docs = df.select(
        F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("doc_hash"),
        F.coalesce(F.regexp_count(F.col(text), F.lit("\n")) + 1, F.lit(0)).cast("long").alias("n_lines"),
    )
    out = docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id AND d.doc_hash = g.doc_hash"), "left")
    removed = F.coalesce(F.col("g.removed"), F.array().cast("array<int>"))
    return out.select("d.doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def without_lines(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """The rows of ``df`` with what is left of their texts; ``n_chars``, if there, follows the text.

    Documents that lose a line and have no word left are dropped: each of their lines is similar to an
    earlier one, which may itself be removed, so what is left need not resemble them.
    """
    gone = removed_lines(df, key, text)
    names = df.columns
    hit = bit_filter(gone, "doc_hash")
    rows = df.select(*[F.col(c).alias(f"kept_{c}") for c in names], F.xxhash64(F.col(text)).alias("hash"))
    # Documents that surely lose nothing need not meet the others.
    same = F.expr(f"r.`kept_{key}` <=> g.doc_id AND r.hash = g.doc_hash")
    changed = hit(rows, F.col("hash")).alias("r").join(gone.alias("g"), same, "left")
    kept = let(
        F.split(F.col(f"kept_{text}"), "\n"),
        lambda lines: F.array_join(F.filter(lines, lambda s, i: ~F.array_contains("g.removed", i)), "\n"),
    )
    new = F.when(F.col("g.removed").isNull(), F.col(f"kept_{text}")).otherwise(kept)
    changed = changed.withColumn("__new", new)
    changed = changed.where(F.col("g.removed").isNull() | (F.btrim("__new", F.lit(SPACE_CHARS)) != ""))

    def column(c, value):
        if c == text:
            return value.alias(c)
        if c == "n_chars":
            return F.length(value).cast(df.schema[c].dataType).alias(c)
        return F.col(f"kept_{c}").alias(c)

    whole = hit(rows, F.col("hash"), passing=False).select(*[F.col(f"kept_{c}").alias(c) for c in names])
    return changed.select(*[column(c, F.col("__new")) for c in names]).unionByName(whole)
