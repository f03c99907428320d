"""SimHash near-duplicates found with BK-trees.

A fingerprint has a bit for each of 64 hash bits: 1 if it is set in over half of the hashes of the
text's 4-word shingles (repeats counted; XXH64, seed 42). Two fingerprints link at ``radius`` or fewer
differing bits; a document's component is all it reaches over links.

Only distinct fingerprints are compared. The 64 bits are cut into ``radius + 2`` blocks, so two linked
fingerprints agree in two blocks at least: each pair of blocks names a shard, and a fingerprint joins
one shard for each pair. A shard has a BK-tree (children keyed by their Hamming distance to the parent),
which its fingerprints query, following only edges within the radius of the distance. A shard of more than ``SHARD`` fingerprints is dealt to
several trees of about that size; each of them is sent to every part of the shard's queries, so
neither trees nor tasks grow with a hot shard. All trees of a batch are built and searched level by
level as numpy arrays. A task reports a link to one representative for each fingerprint, not all pairs;
components over these are found in Spark.

Results for edge cases: a null or empty text, or one without a word, has fingerprint zero and links
like any other. A text of fewer than four words has one shingle of all its words. Repeated rows and
repeated keys are documents of their own with equal fingerprints. The component is the least
key in it, null only if all its keys are null. An empty table gives an empty result.
"""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.common import UPPER, keyed_text, written
from geopulse.llm.components import components

SHINGLE, SEED, RADIUS = 4, 42, 4
SHARD = 4096
# Queries by nodes looked at in one step.
STEP = 1 << 21
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def fingerprint(text: str) -> bytes:
    """The fingerprint as eight bytes, highest bit first."""
    # UTF-8 bytes split at the white space of the word pattern.
    words = text.encode().translate(LOWER).split()
    if not words:
        return bytes(8)
    line, size = b" ".join(words), min(SHINGLE, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_digest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.frombuffer(b"".join([digest(line[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at : at + 65536], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(hashes)).tobytes()


def fingerprints(df: DataFrame, key="doc_id", text="text", keep=()) -> DataFrame:
    """``doc_id, fp``: the fingerprint's 64 bits as a signed long."""
    rows = keyed_text(df, key, text)

    def run(batches):
        for batch in batches:
            raw = b"".join(fingerprint(t) for t in batch.column(1).to_pylist())
            fps = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


class Forest:
    """BK-trees of several groups, built level by level. ``group`` is sorted."""

    def __init__(self, group: np.ndarray, fp: np.ndarray, radius: int):
        self.fp, self.radius = fp, radius
        first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        self.groups, self.roots = group[first], first
        at = first[np.searchsorted(self.groups, group)]
        waiting = np.setdiff1d(np.arange(len(fp)), first, assume_unique=True)
        at, edges, children = at[waiting], [], []
        while len(waiting):
            edge = at * 65 + np.bitwise_count(fp[waiting] ^ fp[at])
            order = np.argsort(edge, kind="stable")
            edge, waiting = edge[order], waiting[order]
            new = np.concatenate([[True], edge[1:] != edge[:-1]])
            # The first at an edge becomes its child; the others go on from there.
            edges.append(edge[new])
            children.append(waiting[new])
            at = waiting[new][np.cumsum(new) - 1][~new]
            waiting = waiting[~new]
        edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(edges)
        self.edges, self.children = edges[order], children[order]

    def near(self, group: np.ndarray, fp: np.ndarray):
        """Yields (query, node) arrays of all pairs within the radius, each query in its group's tree."""
        tree = np.searchsorted(self.groups, group)
        tree[tree == len(self.groups)] = 0
        has = self.groups[tree] == group if len(self.groups) else np.zeros(len(group), bool)
        query = np.flatnonzero(has)
        todo = [(query, self.roots[tree[query]])]
        while todo:
            query, node = todo.pop()
            if len(query) > STEP:
                todo += [(query[i : i + STEP], node[i : i + STEP]) for i in range(0, len(query), STEP)]
                continue
            apart = np.bitwise_count(fp[query] ^ self.fp[node]).astype(np.int64)
            hit = apart <= self.radius
            if hit.any():
                yield query[hit], node[hit]
            low = np.searchsorted(self.edges, node * 65 + np.maximum(apart - self.radius, 0), "left")
            high = np.searchsorted(self.edges, node * 65 + np.minimum(apart + self.radius, 64), "right")
            count = high - low
            if count.any():
                where = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                todo.append((np.repeat(query, count), self.children[where]))


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the sets of a[i] and b[i]; a set's label is its least member."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def links_within(item: np.ndarray, fp: np.ndarray, role: np.ndarray, radius: int):
    """For each fingerprint that links within its item: it and a representative of what it reaches there.

    Roles: 0 in the tree and a query, 1 in the tree, 2 a query.
    """
    full = np.flatnonzero(np.concatenate([[True], item[1:] != item[:-1]]))
    size = np.diff(np.concatenate([full, [len(item)]]))
    keep = np.repeat(size > 1, size)
    # Unsigned, since numpy counts the bits of a signed number's absolute value.
    item, fp, role = item[keep], fp[keep].view(np.uint64), role[keep]
    if not len(item):
        return fp.view(np.int64), fp.view(np.int64)
    in_tree, asks = np.flatnonzero(role != 2), np.flatnonzero(role != 1)
    forest = Forest(item[in_tree], fp[in_tree], radius)
    label = np.arange(len(item))
    for query, node in forest.near(item[asks], fp[asks]):
        label = unite(label, asks[query], in_tree[node])
    moved = np.flatnonzero(label != np.arange(len(item)))
    return fp[moved].view(np.int64), fp[label[moved]].view(np.int64)


def block_pairs(radius: int):
    """Bit masks of all pairs of ``radius + 2`` blocks."""
    cuts = [64 * i // (radius + 2) for i in range(radius + 3)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    masks = [a | b for a, b in combinations(masks, 2)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(fps: DataFrame, radius=RADIUS, shard=SHARD) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints ``fp`` as those within the radius do."""
    pairs = block_pairs(radius)
    keys = F.array(*[F.struct(F.lit(i).alias("pair"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(pairs)])
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.pair", "k.bits")
    hot = keyed.groupBy("pair", "bits").count().where(F.col("count") > shard)
    hot = written(hot.select("pair", "bits", F.ceil(F.col("count") / shard).cast("int").alias("trees")), "hot-shards")
    dealt = keyed.join(hot, ["pair", "bits"], "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
    # Each fingerprint's tree meets the part of every other tree once.
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, trees - 1)")))
    role = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
    item = F.xxhash64("pair", "bits", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(item.alias("item"), "fp", role.cast("int").alias("role"))
    rows = rows.repartition("item").sortWithinPartitions("item")

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            # The last item may go on in the next batch.
            cut = np.searchsorted(now[0], now[0][-1], "left") if len(now[0]) else 0
            held = [x[cut:] for x in now]
            yield from found([x[:cut] for x in now])
        if held is not None:
            yield from found(held)

    def found(columns):
        if len(columns[0]):
            a, b = links_within(columns[0], columns[1], columns[2], radius)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, key="doc_id", text="text", radius=RADIUS, shard=SHARD) -> DataFrame:
    """``doc_id, fp, component_id`` of every row."""
    docs = written(fingerprints(df, key, text), "fingerprints")
    distinct = docs.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), radius, shard))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left")
    named = named.select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(named.join(least, "root").select("fp", "component_id"), "components")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")
