"""Mixing sources to target weights.

Each source's documents are packed, in an order that a hash of the key chooses, into one sequence of words that is cut into blocks
of a fixed length (the last is shorter). A source's target says how many blocks it gives: whole passes
over the sequence (epochs), then part of one more, the last block cut so that the words taken are the target.
The slots of all sources are thrown over output shards (a multinomial draw of each source's count per
shard). A shard's slots of a source are a run of the source's slot numbers, and a pseudorandom permutation of
the source's blocks, another for each epoch, turns a slot number into a block. Slots and
packed documents meet by source and block number.

A target is the source's share by weight of all words, at most ``max_repeats`` times the source's
words; what is over goes to the others by weight, until none is above. Weights repeat in order of the
sources by code point, the null source last.

Only aggregates, windows and equi-joins: prefix sums within a source go over slices of bounded size
and then over the slices' sums, so no task holds a source. Source names and block numbers form
the join key, so that a hot source is spread. The table of sources has one row for each.

Results for edge cases: a null or empty text, or one without a word, has size 0 and gives nothing;
a source without words has target 0. The null source is a source of its own. Repeated rows are
documents of their own. An empty table gives an empty mix. Very long documents span many blocks.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geopulse.llm.common import let, words, written

WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
BLOCK = 256
SHARD_SLOTS = 8192
SLICE_ROWS = 4_000
TASK_SLOTS = 1 << 17
ROUNDS = 24
SEED = 20


def sized_rows(df: DataFrame, key="doc_id", text="text", source="source", keep=()) -> DataFrame:
    """Rows with a number of their own (``row``), a source key that is never null, and the size in words."""
    size = F.coalesce(F.size(words(F.col(text))), F.lit(0)).cast("long")
    rows = df.select(
        F.col(key).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        F.when(F.col(text).isNull(), F.lit(0)).otherwise(size).cast("long").alias("size"),
        F.monotonically_increasing_id().alias("row"),
        *[F.col(c).alias(f"kept_{c}") for c in keep],
    )
    # A letter first keeps the null source apart from every name and after it in order.
    return rows.withColumn("skey", F.coalesce(F.concat(F.lit("a"), "source"), F.lit("b")))


def targets(sized: DataFrame, weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """``skey, source_size, target`` of each source."""
    sources = sized.groupBy("skey").agg(F.sum("size").alias("source_size"))
    # One row for each source: a dimension, small enough for one window.
    rank = F.row_number().over(Window.orderBy("skey")) - 1
    sources = sources.withColumn("weight", F.element_at(F.lit([float(w) for w in weights]), F.pmod(rank, F.lit(len(weights))) + 1))
    sources = sources.withColumn("cap", (max_repeats * F.col("source_size")).cast("double"))
    # Sources reach their cap in the order of cap per weight. One is capped if its share of what
    # those before it leave is at least its cap.
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "skey")
    before, rest = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    total = F.sum("source_size").over(every)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    sources = sources.withColumn("total", total.cast("double")).withColumn("capped", level * F.col("weight") >= F.col("cap"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(every), F.lit(0.0))
    shared = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(every)
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", left * F.col("weight") / shared))
    return sources.select("skey", "source_size", target.alias("target"))


def permuted(index, blocks, *names, inverse=False):
    """Where a permutation of ``0 .. blocks - 1`` that ``names`` choose takes ``index``.

    A swap-or-not network: in each round an index and its mirror image about a random point change
    places or not, as a random bit of the pair says. Each round undoes itself.
    """
    rounds = list(range(ROUNDS))

    def swap(at, r):
        point = F.pmod(F.xxhash64(*names, r), blocks)
        other = F.pmod(point - at, blocks)
        bit = F.xxhash64(*names, r, F.greatest(at, other)).bitwiseAND(F.lit(1))
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(F.lit(rounds[::-1] if inverse else rounds), index, swap)


def quotas(target: DataFrame, block=BLOCK, seed=SEED) -> DataFrame:
    """What each source gives, in slots: ``epochs`` whole passes over its ``blocks``, then slots
    for ``words_left`` words of one more, in which its last (shorter) block stands at ``short_at``."""
    size, length = F.col("source_size"), F.lit(block)
    wanted = F.round("target").cast("long")
    got = target.where("source_size > 0").select("skey", "source_size", wanted.alias("wanted"))
    got = got.select(
        "skey",
        F.ceil(size / length).cast("long").alias("blocks"),
        F.expr("wanted div source_size").alias("epochs"),
        F.expr("wanted % source_size").alias("words_left"),
    ).join(target.select("skey", "source_size"), "skey")
    short = size - (F.col("blocks") - 1) * length
    got = got.withColumn("short", short).withColumn(
        "short_at", permuted(F.col("blocks") - 1, F.col("blocks"), F.lit(seed), F.col("skey"), F.col("epochs"), inverse=True)
    )
    plain = F.ceil(F.col("words_left") / length)
    with_short = F.ceil((F.col("words_left") + length - F.col("short")) / length)
    last = F.when(F.col("words_left") <= F.col("short_at") * length, plain).otherwise(with_short)
    return got.withColumn("slots", (F.col("epochs") * F.col("blocks") + last).cast("long"))


def drawn_slots(quota: DataFrame, block=BLOCK, shard_slots=SHARD_SLOTS, seed=SEED) -> DataFrame:
    """Every slot of the mix: ``skey, shard, slot, epoch, block, take`` (words taken of the block)."""
    total = quota.agg(F.sum("slots")).first()[0] or 0
    shards = max(1, -(-total // shard_slots))
    about = ["skey", "blocks", "epochs", "words_left", "short", "short_at"]
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1, F.lit(shard_slots).cast("long")))
    runs = quota.where("slots > 0").select(*about, "slots", starts.alias("start"))
    runs = runs.repartition(-(-total // TASK_SLOTS) or 1, "skey", "start")
    end = F.least(F.col("start") + shard_slots, "slots") - 1
    thrown = runs.select(*about, F.explode(F.sequence("start", end)).alias("slot"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "skey", "slot"), F.lit(shards))
    counts = thrown.withColumn("shard", shard).groupBy(*about, "shard").count()
    upto = F.sum("count").over(Window.partitionBy("skey").orderBy("shard"))
    # A row becomes a shard's slots, so few rows are much work: dealt out by number of slots.
    tasks = -(-total // TASK_SLOTS) or 1
    counts = counts.withColumn("first", upto - F.col("count")).repartition(tasks, "skey", "shard")
    slots = counts.select(*about, "shard", F.explode(F.expr("sequence(first, first + count - 1)")).alias("slot"))
    slots = slots.withColumn("epoch", F.expr("slot div blocks")).withColumn("index", F.expr("slot % blocks"))
    slots = slots.withColumn("block", permuted(F.col("index"), F.col("blocks"), F.lit(seed), F.col("skey"), F.col("epoch")))
    # In the last pass the words before a slot tell how much of its block is still wanted.
    missing = F.when(F.col("index") > F.col("short_at"), F.lit(block) - F.col("short")).otherwise(0)
    wanted = F.col("words_left") - (F.col("index") * block - missing)
    take = F.when(F.col("epoch") < F.col("epochs"), F.lit(block)).otherwise(F.least(F.lit(block), wanted))
    return slots.select("skey", "shard", "slot", "epoch", "block", take.cast("long").alias("take"))


def packed(sized: DataFrame, n_rows: int, block=BLOCK, seed=SEED) -> DataFrame:
    """Each document's parts in its source's blocks: ``skey, block, row, doc_id, word, low, high``.

    ``word`` is the part's first word in the document; it fills the block from ``low`` to ``high``.
    """
    slices = max(1, -(-n_rows // SLICE_ROWS))
    rows = sized.where("size > 0").withColumn("slice", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(slices)))
    sums = rows.groupBy("skey", "slice").agg(F.sum("size").alias("sum"))
    base = F.sum("sum").over(Window.partitionBy("skey").orderBy("slice")) - F.col("sum")
    sums = sums.select("skey", "slice", base.alias("base"))
    # All rows of one repeated key share a slice; their number follows the repeats alone.
    order = Window.partitionBy("skey", "slice").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size", "row")
    rows = rows.withColumn("start", F.sum("size").over(order) - F.col("size")).join(sums, ["skey", "slice"])
    rows = rows.withColumn("start", F.col("start") + F.col("base")).withColumn("end", F.col("start") + F.col("size"))
    spans = F.explode(F.expr(f"sequence(start div {block}, (end - 1) div {block})"))
    parts = rows.select("skey", "row", "doc_id", "start", "end", spans.alias("block"))
    from_word, to_word = F.col("block") * block, (F.col("block") + 1) * block
    low, high = F.greatest("start", from_word), F.least("end", to_word)
    return parts.select(
        "skey", "block", "row", "doc_id", (low - F.col("start")).alias("word"), (low - from_word).alias("low"), (high - from_word).alias("high")
    )


def mixed_parts(sized: DataFrame, target: DataFrame, block=BLOCK, shard_slots=SHARD_SLOTS, seed=SEED) -> DataFrame:
    """The mix as parts of documents: ``shard, slot, skey, epoch, block, row, doc_id, word, n_words``."""
    n_rows = sized.count()
    slots = drawn_slots(written(quotas(target, block, seed), "quotas"), block, shard_slots, seed)
    # What slots come to is not seen in the size of the rows they are made of, so no side is broadcast.
    parts = packed(sized, n_rows, block, seed).join(slots.hint("merge"), ["skey", "block"])
    n_words = F.least("high", "take") - F.col("low")
    return parts.where(n_words > 0).select(
        "shard", "slot", "skey", "epoch", "block", "row", "doc_id", "word", n_words.alias("n_words")
    )


def mix(df: DataFrame, key="doc_id", text="text", source="source", weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row."""
    sized = written(sized_rows(df, key, text, source), "sized")
    target = written(targets(sized, weights, max_repeats), "targets")
    taken = mixed_parts(sized, target).groupBy("row").agg(F.sum("n_words").alias("taken"))
    out = sized.join(taken, "row", "left").join(target, "skey")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(df: DataFrame, key="doc_id", text="text", source="source", weights=WEIGHTS, max_repeats=MAX_REPEATS) -> DataFrame:
    """The mix as documents with the columns of ``df``: a row for each pass that takes words of a
    document. Where a pass takes it whole the text is as it was, else the words taken, in order."""
    names = df.columns
    sized = written(sized_rows(df, key, text, source, keep=names), "mixed")
    light = sized.select("doc_id", "source", "size", "row", "skey")
    target = written(targets(light, weights, max_repeats), "targets")
    parts = mixed_parts(light, target).groupBy("row", "epoch").agg(
        F.sum("n_words").alias("taken"), F.array_sort(F.collect_list(F.struct("word", "n_words"))).alias("parts")
    )
    out = sized.join(parts, "row")
    cut = let(
        words(F.col(f"kept_{text}")),
        lambda w: F.array_join(F.flatten(F.transform("parts", lambda p: F.slice(w, (p["word"] + 1).cast("int"), p["n_words"].cast("int")))), " "),
    )
    new = F.when(F.col("taken") == F.col("size"), F.col(f"kept_{text}")).otherwise(cut)
    return out.select(*[(new if c == text else F.col(f"kept_{c}")).alias(c) for c in names])
