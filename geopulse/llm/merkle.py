"""Merkle manifest of a dataset by time-forward processing: root, proofs, and what verifies.

Every row is a leaf, a digest of its fields. The leaves of a group ascend by key; every ``FAN`` consecutive
nodes become their digest until one is left, the group's subroot. The subroots, ordered by group, become
the root in the same way.

The tree is a graph whose edges go forward in the order of node labels (level, place). Processing is forward
in that time: a node's digest is a message to its parent, kept in a priority queue ordered by the label of
who receives it; when a node's turn comes, all its messages stand at the head of the queue. The external
queue is a shuffle sorted by label: a round takes ``DEPTH`` levels, messages are dealt to blocks of ``FAN **
DEPTH`` consecutive nodes, and inside a block a heap passes digests up, so neither a task nor memory
grows with a group. A block's top node goes to the next round, whose table is that many times smaller. The
reversed sweep takes the rounds backwards: a block receives the proof suffix of its top node ahead of
its leaves (place -1 sorts first) and hands each child the siblings of its run before that suffix.

A proof is text: for each level ``left,right;``, the digests of the siblings before and after the node,
joined. ``folded`` recomputes a root from a leaf and its proof.

Results for edge cases: null fields count as ``-``, a null group is the first group, a null key the least
key. Rows with one key are ordered by their digests; rows that are equal in every field have equal leaves
and take places in turn. A lone leaf is its group's subroot, a lone subroot the root; a proof without
siblings is the empty text. Very long texts are hashed whole. Columns other than those named are ignored, whatever their
names. An empty table gives an empty result.
"""

import hashlib
import heapq
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopulse.llm.common import free, written

FAN = 3
# Levels in one round: a block has 3 ** 5 = 243 nodes.
DEPTH = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(value) -> Column:
    return F.sha2(value.cast("binary"), 256)


def field(value) -> Column:
    """A field of a leaf: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(values) -> Column:
    return digest(F.concat(*[field(v) for v in values]))


def numbered(rows: DataFrame, order) -> DataFrame:
    """Adds ``pos``, the place of a row in its ``grp`` by ``order``, and ``n``, the size of the group.

    Rows are dealt by ranges, so a hot group is many tasks' work; what lies before a task is a sum over
    one row for each task and group.
    """
    # Equal rows are told apart by where they come from, or many of them would be one task's work.
    order = [F.col("grp"), *order, F.col("tie")]
    sorted_rows = rows.withColumn("tie", F.monotonically_increasing_id())
    sorted_rows = sorted_rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie")
    # The number has the task in its upper bits and counts the sorted rows of a task in the lower ones.
    at = written(sorted_rows.withColumn("mid", F.monotonically_increasing_id()), "merkle-sorted")
    task = F.shiftright("mid", 33)
    spans = at.groupBy("grp", task.alias("task")).agg(F.min("mid").alias("first"), F.count(F.lit(1)).alias("size"))
    all_of, earlier = Window.partitionBy("grp"), Window.partitionBy("grp").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select("grp", "task", "first", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"), F.sum("size").over(all_of).alias("n"))
    out = at.withColumn("task", task).join(spans, ["grp", "task"])
    pos = F.col("before") + F.col("mid") - F.col("first")
    out = written(out.select(*rows.columns, pos.alias("pos"), "n"), "merkle-numbered")
    free(at)
    return out


def climb(digests, levels):
    """The levels of a block from its leaves to its top, through a queue ordered by label."""
    queue = [(0, place, d) for place, d in enumerate(digests)]
    rows = [list(digests)] + [[] for _ in range(levels)]
    while queue:
        level, place, _ = queue[0]
        if level == levels:
            break
        run = place // FAN
        got = []
        # The messages of one parent are next to each other at the head.
        while queue and queue[0][0] == level and queue[0][1] // FAN == run:
            got.append(heapq.heappop(queue)[2])
        made = hashlib.sha256("".join(got).encode()).hexdigest()
        rows[level + 1].append(made)
        heapq.heappush(queue, (level + 1, run, made))
    return rows


def height(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    levels, size = 0, 1
    while size < n:
        levels, size = levels + 1, size * FAN
    return levels


def blocks(batches):
    """Groups sorted rows by their first two columns, over the borders of batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns]):
            if row[:2] != key:
                if rows:
                    yield key, rows
                key, rows = row[:2], []
            rows.append(row)
    if rows:
        yield key, rows


def in_batches(rows, schema: pa.Schema, size=2000):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def lifted(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks: ``grp, pos, n, digest`` as the next round's nodes."""
    schema = pa.schema([("grp", pa.string()), ("pos", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches):
        def tops():
            for (grp, block), rows in blocks(batches):
                n = rows[0][3]
                top = climb([r[4] for r in rows], min(DEPTH, height(n)))[-1][0]
                yield grp, block, -(-n // FAN**DEPTH), top

        yield from in_batches(tops(), schema)

    rows = nodes.select("grp", block_of("pos"), "pos", "n", "digest")
    rows = rows.repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    return rows.mapInArrow(run, "grp string, pos long, n long, digest string")


def block_of(pos) -> Column:
    return F.floor(F.col(pos) / FAN**DEPTH).cast("long").alias("block")


def siblings(rows, place: int) -> str:
    """The proof of a leaf of a block up to its top."""
    out = []
    for level in rows[:-1]:
        first = place - place % FAN
        out.append(f"{''.join(level[first:place])},{''.join(level[place + 1:first + FAN])};")
        place //= FAN
    return "".join(out)


def handed_down(nodes: DataFrame, above: DataFrame, keep=()) -> DataFrame:
    """``grp, pos, proof, subroot, root`` and ``keep`` of every node.

    ``above`` has ``grp, pos, proof, subroot, root`` of the tops of the blocks.
    """
    message = ["proof", "subroot", "root"]
    none = [F.lit(None).cast("string").alias(c) for c in message]
    down = nodes.select("grp", block_of("pos"), "pos", "n", "digest", *none, *keep)
    first = above.select(
        "grp", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"),
        F.lit("").alias("digest"), *message, *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in keep],
    )
    rows = down.unionByName(first).repartition("grp", "block").sortWithinPartitions("grp", "block", "pos")
    kinds = [nodes.schema[c].dataType.simpleString() for c in keep]

    def run(batches):
        first_batch = next(batches, None)
        if first_batch is None:
            return
        made = [("grp", pa.string()), ("pos", pa.int64()), *[(c, pa.string()) for c in ("digest", *message)]]
        schema = pa.schema([*made, *[(c, first_batch.column(8 + i).type) for i, c in enumerate(keep)]])

        def leaves():
            for (grp, _), rows in blocks(chain([first_batch], batches)):
                suffix, subroot, root = rows[0][5:8]
                rows = rows[1:]
                levels = climb([r[4] for r in rows], min(DEPTH, height(rows[0][3])))
                for place, row in enumerate(rows):
                    yield grp, row[2], row[4], siblings(levels, place) + suffix, subroot, root, *row[8:]

        yield from in_batches(leaves(), schema)

    extra = "".join(f", `{c}` {k}" for c, k in zip(keep, kinds))
    return rows.mapInArrow(run, "grp string, pos long, digest string, proof string, subroot string, root string" + extra)


def tree(nodes: DataFrame):
    """``(tops, rounds)``: one node for each group, and the tables of the rounds below, first one first.

    The driver sees the size of the largest group, which says how many rounds there are.
    """
    most = nodes.agg(F.max("n")).first()[0] or 0
    rounds, size = [nodes], most
    while size > 1:
        # Groups that have one node wait as they are.
        now = rounds[-1]
        done = now.where("n = 1").select("grp", "pos", "n", "digest")
        rounds.append(written(lifted(now.where("n > 1")).unionByName(done), "merkle-round"))
        size = -(-size // FAN**DEPTH)
    return rounds.pop(), rounds


def proofs_of(tops: DataFrame, rounds, keep=()) -> DataFrame:
    """Proofs of the first table's nodes, from ``grp, pos, proof, subroot, root`` of the tops.

    A group that has one node in a round takes its message as it is.
    """
    for i, nodes in reversed(list(enumerate(rounds))):
        extra = keep if i == 0 else ()
        below = handed_down(nodes, tops, extra)
        if i:
            below = written(below, "merkle-proofs")
            free(tops)
        tops = below
    return tops


def manifest(df: DataFrame, key="doc_id", group="source", fields=FIELDS, keep=None) -> DataFrame:
    """``doc_id, leaf, proof, subroot, root`` of every row, and ``keep``: new names with a Column each.

    ``keep`` may hold any Column over ``df``, such as the leaf of other values.
    """
    keep = keep or {}
    own = F.col(group).cast("string")
    grp = F.when(own.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), own))
    leaves = df.select(
        grp.alias("grp"), F.col(key).alias("doc_id"), leaf([F.col(f) for f in fields]).alias("digest"),
        *[c.alias(f"kept_{name}") for name, c in keep.items()],
    )
    # Written first: the ranges are sampled, and texts should be hashed once.
    leaves = written(leaves, "merkle-leaves")
    nodes = numbered(leaves, [F.col("doc_id"), F.col("digest")])
    free(leaves)
    subroots, rounds = tree(nodes)
    groups = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    top, upper = tree(numbered(groups, [F.col("name")]))
    top = top.select("grp", "pos", F.lit("").alias("proof"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    high = proofs_of(top, upper, ("name",)) if upper else top.limit(0)
    if upper:
        high = written(high, "merkle-high")
        tops = high.select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "proof", F.col("digest").alias("subroot"), "root")
    else:
        # One group: its subroot is the root.
        tops = subroots.select("grp", "pos", F.lit("").alias("proof"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    extra = ("doc_id", *[f"kept_{name}" for name in keep])
    if rounds:
        out = proofs_of(written(tops, "merkle-tops"), rounds, extra)
    else:
        out = nodes.join(tops.drop("pos"), "grp")
    columns = ["doc_id", F.col("digest").alias("leaf"), "proof", "subroot", "root"]
    return out.select(*columns, *[F.col(f"kept_{name}").alias(name) for name in keep])


def fold(leaf_digest: str, proof: str) -> str:
    """The root that a leaf has by its proof."""
    for level in proof.split(";")[:-1]:
        left, right = level.split(",")
        leaf_digest = hashlib.sha256(f"{left}{leaf_digest}{right}".encode()).hexdigest()
    return leaf_digest


def folded(df: DataFrame, leaf_col="leaf", proof_col="proof", out="folded_root") -> DataFrame:
    """Adds the root recomputed from a leaf and a proof; null where either is null."""

    def run(batches):
        for batch in batches:
            roots = [None if a is None or b is None else fold(a, b) for a, b in zip(batch.column(leaf_col).to_pylist(), batch.column(proof_col).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.string())], [*batch.schema.names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{fields}, `{out}` string")
