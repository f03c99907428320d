"""One document of each group of near copies: all pairs whose shingle sets have Jaccard similarity 0.8 or more.

A document is the set of its five-word shingles (A-Z lower-cased; a text of fewer words is one shingle),
as 64-bit hashes. Documents link at similarity 0.8 or more; a group is all that links reach. No pair is
left to chance:

1. Equal sets are one class. The shingles of a class are ordered by rarity, a count over the whole corpus
   in ``BUCKETS`` hashed counters (any order is right, rarity makes it cheap).
2. Two similar sets share a shingle among the first ``n - ceil(0.8 n) + 1`` of each (prefix filter), so
   classes meet at those; shingles that one class alone has there meet nobody and are dropped.
3. First each class meets the least one at each of its shingles, and what BK-trees find within
   ``simhash_trees.RADIUS`` bits of its SimHash fingerprint. Pairs are checked on the whole sets, and
   components over those that hold join most members of large groups without all their pairs. Pairs whose parity vectors
   differ too much are left out before (no similar pair is among them).
4. Then all pairs that meet and are not in one component yet are checked the same way, those that meet at
   enough shingles for their sizes: long texts that have a passage in common do not.

Results for edge cases: null and empty texts and those without a word are one class. Texts of up to three
shingles link only if their sets are equal. Repeated rows are equal. The least key of a group stays,
null only if all its keys are null. Very long texts are whole. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm import simhash_trees
from geopulse.llm.common import free, fresh, keyed_text, written
from geopulse.llm.components import components
from geopulse.llm.line_dedup import bit_filter
from geopulse.llm.scaled_sketch import Sketcher

SHINGLE = 5
BUCKETS = 1 << 16
# The counters travel in so many parts.
PARTS = 16
# Postings or hashes in one batch.
STEP = 1 << 18
# Bits of a parity vector of bounded size at most.
PARITY = 2048


def shingle_set(tool: Sketcher, text: str) -> np.ndarray:
    return tool.sketch(text.encode().translate(simhash_trees.LOWER))[1]


def class_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def parity(hashes: np.ndarray, most=PARITY) -> np.ndarray:
    """The parity vector of a set as 64-bit words. Two sets differ in at least as many members as bits.

    Bit i is the parity of how many members name it. It has as many bits as the set has members, up to a power of two
    from 64 to ``most`` (None: no bound): unrelated sets then differ in two fifths of them at least, similar ones in
    two ninths. Large sets of a bounded vector differ in less, whatever they are. Its two halves xor-ed are the
    vector of half as many bits.
    """
    width = max(64, 1 << (len(hashes) - 1).bit_length())
    width = width if most is None else min(most, width)
    counts = np.bincount((hashes >> np.uint64(20) & np.uint64(width - 1)).astype(np.int64), minlength=width)
    return np.packbits(counts.astype(np.uint8) & 1).view(np.int64)


def described(df: DataFrame, key, text) -> DataFrame:
    """``doc_id, text_hash, cls, n, fp, parity`` of every row, and for each task its counters as rows with a ``part``."""
    rows = keyed_text(df, key, text).withColumn("text_hash", F.xxhash64("text"))
    names = ["doc_id", "text_hash", "cls", "n", "fp", "parity", "part", "counts"]
    words = pa.list_(pa.int64())

    def run(batches):
        tool, counts, kind = Sketcher(SHINGLE, 0), np.zeros(BUCKETS, np.int64), None
        for batch in batches:
            kind, texts = batch.column(0).type, batch.column(1).to_pylist()
            classes, sizes, parities = [], [], []
            for t in texts:
                h = shingle_set(tool, t)
                np.add.at(counts, h & np.uint64(BUCKETS - 1), 1)
                classes.append(class_of(h))
                sizes.append(len(h))
                parities.append(parity(h, None))
            fps = np.frombuffer(b"".join(map(simhash_trees.fingerprint, texts)), ">i8").astype(np.int64)
            none = pa.nulls(len(texts), pa.int32()), pa.nulls(len(texts), pa.binary())
            columns = [batch.column(0), batch.column(2), pa.array(classes, pa.int64()), pa.array(sizes, pa.int32()), pa.array(fps), pa.array(parities, words), *none]
            yield pa.RecordBatch.from_arrays(columns, names)
        if kind is not None:
            none = [pa.nulls(PARTS, t) for t in (kind, pa.int64(), pa.int64(), pa.int32(), pa.int64(), words)]
            parts = [p.tobytes() for p in np.split(counts, PARTS)]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, cls long, n int, fp long, parity array<long>, part int, counts binary")


def rarity(tallies: DataFrame) -> np.ndarray:
    """Three times the logarithm of each counter's sum. The driver sees ``PARTS`` rows."""

    def run(batches):
        total = {}
        for batch in batches:
            for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total[part] = total.get(part, 0) + np.frombuffer(raw, np.int64)
        parts = [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(parts, ["part", "counts"])

    out = np.zeros((PARTS, BUCKETS // PARTS), np.int64)
    for part, raw in tallies.repartition("part").mapInArrow(run, "part int, counts binary").collect():
        out[part] = np.frombuffer(raw, np.int64)
    return np.floor(3 * np.log2(out.ravel() + 1)).astype(np.uint8)


def meetings(df: DataFrame, levels: np.ndarray, key, text) -> DataFrame:
    """``token, cls, n, pos`` of the shingles at which two classes or more meet."""
    schema, names = "token long, cls long, n int, pos int", ["token", "cls", "n", "pos"]

    def post(batches):
        tool, held, size = Sketcher(SHINGLE, 0), [], 0

        def batch_of():
            columns = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            for t in batch.column(1).to_pylist():
                h = shingle_set(tool, t)
                n = len(h)
                if n < 4:
                    continue
                length = n - (4 * n + 4) // 5 + 1
                order = levels[h & np.uint64(BUCKETS - 1)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
                first = np.sort(order)[:length].view(np.int64)
                held.append((first, np.full(length, class_of(h)), np.full(length, n, np.int32), np.arange(length, dtype=np.int32)))
                size += length
                if size >= STEP:
                    yield batch_of()
                    held, size = [], 0
        if held:
            yield batch_of()

    def shared(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(4)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            # The last token may go on in the next batch.
            cut = np.searchsorted(now[0], now[0][-1], "left") if len(now[0]) else 0
            held = [x[cut:] for x in now]
            yield met([x[:cut] for x in now])
        if held is not None:
            yield met(held)

    def met(columns):
        token, cls = columns[0], columns[1]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])])[: len(token)]
        columns = [c[new] for c in columns]
        same = columns[0][1:] == columns[0][:-1]
        keep = (np.concatenate([[False], same]) | np.concatenate([same, [False]]))[: len(columns[0])]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in columns], names)

    posted = keyed_text(df, key, text).mapInArrow(post, schema)
    return posted.repartition("token").sortWithinPartitions("token", "cls").mapInArrow(shared, schema)


def may_match(a: str, b: str):
    """Whether lengths and places leave room for similarity 0.8 (4/9 of the sum in common)."""
    return F.expr(
        f"5 * least({a}.n, {b}.n) >= 4 * greatest({a}.n, {b}.n) AND "
        f"least({a}.pos, {b}.pos) + least({a}.n - {a}.pos, {b}.n - {b}.pos) >= (4 * ({a}.n + {b}.n) + 8) div 9"
    )


def pairs_with_least(met: DataFrame) -> DataFrame:
    least = met.groupBy("token").agg(F.min(F.struct("cls", "n", "pos")).alias("hub")).select("token", "hub.*")
    at = F.expr("a.token = b.token AND a.cls > b.cls") & may_match("a", "b")
    return met.alias("a").join(least.alias("b"), at).select(F.col("a.cls").alias("a"), F.col("b.cls").alias("b"))


def pairs_by_fingerprint(classes: DataFrame) -> DataFrame:
    """Classes with the first of their fingerprint, and those firsts by the links of BK-trees; and the table
    of firsts, which they read."""
    first = written(classes.groupBy("fp").agg(F.min("cls").alias("first")), "near-fingerprints")
    same = classes.join(first, "fp").where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b"))
    links = simhash_trees.links(first.select("fp"))
    links = links.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a")
    links = links.join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    return same.unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b"))), first


def pairs_apart(met: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs that meet and have different labels, and the tables they read."""
    met = met.join(labels, met["cls"] == labels["node"], "left").select("token", "cls", "n", "pos", F.coalesce("root", "cls").alias("label"))
    labelled = met = written(met, "near-labelled")
    mixed = met.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("token")
    met = written(met.join(mixed, "token", "left_semi"), "near-mixed")
    free(labelled)
    at = F.expr("a.token = b.token AND a.cls > b.cls AND a.label <> b.label") & may_match("a", "b")
    sizes = F.first("a.n").alias("na"), F.first("b.n").alias("nb"), F.count(F.lit(1)).alias("common")
    both = met.alias("a").join(met.alias("b"), at).groupBy(F.col("a.cls").alias("a"), F.col("b.cls").alias("b")).agg(*sizes)
    return both.where(may_have_enough()).select("a", "b"), [met]


def may_have_enough():
    """Whether ``common`` shingles among the first ones of both sets leave room for similarity 0.8.

    What two sets have in common beyond these comes after the first ones of one of them. A token where all have one
    label is not among them, but there a pair of two labels does not meet.
    """
    return F.expr("common + greatest((4 * na + 4) div 5, (4 * nb + 4) div 5) - 1 >= (4 * (na + nb) + 8) div 9")


def may_be_similar(described: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs whose sizes and parity vectors leave room for similarity 0.8."""
    signs = described.groupBy("cls").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    both = pairs.join(signs.toDF("a", "na", "x"), "a").join(signs.toDF("b", "nb", "y"), "b")
    # Of sizes that near, one vector is at most twice as long as the other.
    both = both.where(5 * F.least("na", "nb") >= 4 * F.greatest("na", "nb"))
    width = F.least(F.size("x"), F.size("y"))

    def folded(v):
        halves = F.zip_with(F.slice(v, 1, width), F.slice(v, width + 1, width), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(v) > width, halves).otherwise(F.col(v))

    bits = F.zip_with(folded("x"), folded("y"), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    apart = F.aggregate(bits, F.lit(0), lambda acc, n: acc + n)
    return both.where(9 * apart <= F.col("na") + F.col("nb")).select("a", "b")


def similar(df: DataFrame, described: DataFrame, pairs: DataFrame, key, text) -> DataFrame:
    """The pairs ``a, b`` whose whole sets have similarity 0.8 or more.

    Two sets of similarity 0.8 differ in a ninth of the sum of their sizes at most, and so do their parity
    vectors: most other pairs go by these, and only sets of the rest are fetched and compared.
    """
    pairs = written(may_be_similar(described, pairs.distinct()), "near-pairs")
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    needed = written(described.join(needed, "cls", "left_semi").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "near-needed")
    rows = keyed_text(df, key, text)
    rows = bit_filter(needed, "doc_id")(rows, F.col("doc_id"))

    def run(batches):
        tool = Sketcher(SHINGLE, 0)
        for batch in batches:
            for texts in np.array_split(np.array(batch.column(1).to_pylist(), object), batch.num_rows // 500 + 1):
                sets = [shingle_set(tool, t).view(np.int64) for t in texts]
                columns = [pa.array([class_of(h) for h in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["cls", "h"])

    sets = rows.mapInArrow(run, "cls long, h array<long>").join(needed.select("cls"), "cls", "left_semi")
    sets = written(sets.groupBy("cls").agg(F.first("h").alias("h")), "near-sets")
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    both = both.where(9 * F.size(F.array_intersect("x", "y")) >= 4 * (F.size("x") + F.size("y"))).select("a", "b")
    both = written(both, "near-links")
    free(pairs, needed, sets)
    return both


def grouped(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``doc_id, text_hash, root, component_id`` of every row; ``root`` names its group."""
    all_rows = written(described(df, key, text), "near-docs")
    docs = all_rows.where("part IS NULL").select("doc_id", "text_hash", "cls", "n", "fp", "parity")
    levels = rarity(all_rows.where("part IS NOT NULL").select("part", "counts"))
    met = written(meetings(df, levels, key, text), "near-meetings")
    classes = docs.groupBy("cls").agg(F.first("fp").alias("fp"))
    by_fingerprint, first = pairs_by_fingerprint(classes)
    early = similar(df, docs, pairs_with_least(met).unionByName(by_fingerprint), key, text)
    apart, used = pairs_apart(met, components(early))
    rest = similar(df, docs, apart, key, text)
    free(met, first, *used)
    roots = components(early.unionByName(rest))
    named = docs.join(roots, F.col("cls") == F.col("node"), "left").select("doc_id", "text_hash", F.coalesce("root", "cls").alias("root"))
    named = written(named, "near-roots")
    free(all_rows, early, rest, roots)
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("doc_id", "text_hash", "root", "component_id")


def near_copies(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """``doc_id, component_id`` of every row."""
    return grouped(df, key, text).select("doc_id", "component_id")


def one_of_each(df: DataFrame, key="doc_id", text="text") -> DataFrame:
    """One row of ``df`` for each group: one with the group's least key (null only if it has no other).

    Rows are told apart by key and text: of rows that repeat a key those of other groups stay. Of rows that repeat
    both, any one stays.
    """
    found = grouped(df, key, text)
    order = F.struct(F.col("doc_id").isNull().alias("no_key"), "doc_id", "text_hash")
    stay = found.groupBy("root").agg(F.min(order).alias("row")).select("row.doc_id", "row.text_hash")
    own = fresh(df, "stay_row")
    stay = written(stay, "near-stay")
    # Key and hash in one struct, where null equals null: the join and what drops repeated rows want the same
    # partitions then, so texts are shuffled once.
    marked = df.withColumn(own, F.struct(F.col(key).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")))
    # Never null, which a table that is read does not know: a cast of either side's struct would cost the partitions.
    stay = stay.select(F.struct("doc_id", F.coalesce("text_hash", F.lit(0).cast("bigint")).alias("text_hash")).alias(own))
    return marked.join(stay, own, "left_semi").dropDuplicates([own]).drop(own)
