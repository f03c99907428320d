"""Language-model scores by deleted interpolation.

The model gives a word after another the probability
``l2 * c(u v) / c(u) + l1 * c(v) / N + l0 / (V + 1)``: maximum-likelihood estimates of order two and one and a
uniform one. The weights depend on the bucket of the context's frequency (whole powers of two of c(u)). They are learned by
expectation-maximisation on held-out counts: training documents fall into two folds, and the words of
each are events under the counts of the other.

Counting and scoring are Spark jobs over batches of whole documents of about ``BATCH`` tokens:

1. A batch keeps its documents as numbers into its own list of word hashes.
2. It asks for each of its distinct words and word pairs once, with its own counts per fold. Requests go to
   shards by hash; a frequent pair comes once for each batch, not once for each occurrence.
3. A shard adds up what all batches counted and answers each with the totals.
4. A batch meets its answers; held-out events are summed in cells of (bucket, estimate of order two, estimate of
   order one), a table of fixed size, from which the driver learns the weights.
5. With the weights the batch scores its documents.

A document ends with an end token, which is also the context of its first word. Words are as in
``common.WORD``, with A-Z lower-cased, and stand as hashes of 56 bits.

Results for edge cases: a null or empty text, or one without a word, is one end token. Without training
documents all counts are zero and only the uniform estimate is left. Very long texts are one batch
of their own. Repeated rows count and score as documents of their own. A null key is in no training fold.
"""

import os

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.common import UPPER, written

BATCH = 3 << 19
# Word hashes of a shard share their first bits; there are 2**8 shards at least.
LEAST_SHARD_BITS = 8
SHARD_TOKENS = 1 << 22
END = b" "
LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
# Cells of the held-out table: steps of 1/8 in the natural logarithm of an estimate.
STEPS, CELLS = 8, 512
ITERATIONS = 60


# Bytes of a word's hash.
WORD_BYTES = 7


def pack(numbers: np.ndarray) -> bytes:
    """Unsigned numbers compressed by byte planes: high bytes are mostly zero."""
    planes = np.ascontiguousarray(numbers).reshape(-1, 1).view(np.uint8).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def unpack(data: bytes, kind) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    planes = planes.reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def pack_counts(first: np.ndarray, second: np.ndarray) -> bytes:
    """Two counts for each key; most are below 15 and share a byte, the others follow."""
    small = (first < 15) & (second < 15)
    codes = np.where(small, first * 16 + second, 255).astype(np.uint8)
    rest = np.stack([first[~small], second[~small]]).astype(np.uint64)
    return len(codes).to_bytes(8, "big") + zstandard.ZstdCompressor(level=3).compress(codes.tobytes() + rest.tobytes())


def unpack_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[:8], "big")
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    codes = np.frombuffer(raw, np.uint8, size)
    out = np.stack([codes >> 4, codes & 15]).astype(np.uint64)
    out[:, codes == 255] = np.frombuffer(raw[size:], np.uint64).reshape(2, -1)
    return out


class Numbers(dict):
    """Words to numbers in order of appearance."""

    def __missing__(self, word):
        out = self[word] = len(self)
        return out


BATCHES = "batch long, doc_ids array<long>, roles array<int>, sizes array<int>, vocab binary, tokens binary"


def batches_of(docs: DataFrame) -> DataFrame:
    """Whole documents in batches. ``docs``: ``doc_id, text, role`` (-1: not learned from, 0 and 1: folds)."""

    def run(arrows):
        numbers, held = Numbers({END: 0}), []

        def row():
            vocab = b"".join(xxhash.xxh64_digest(w)[:WORD_BYTES] for w in numbers)
            columns = [
                [int.from_bytes(os.urandom(7), "big")], [[h[0] for h in held]], [[h[1] for h in held]],
                [[len(h[2]) for h in held]], [vocab], [pack(np.concatenate([h[2] for h in held]))],
            ]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            names = ["batch", "doc_ids", "roles", "sizes", "vocab", "tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        total = 0
        for arrow in arrows:
            for key, text, role in zip(*(arrow.column(i).to_pylist() for i in range(3))):
                words = text.encode().translate(LOWER).split()
                tokens = np.empty(len(words) + 1, np.uint32)
                tokens[:-1] = np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))
                tokens[-1] = 0
                held.append((key, role, tokens))
                total += len(tokens)
                if total >= BATCH:
                    yield row()
                    numbers, held, total = Numbers({END: 0}), [], 0
        if held:
            yield row()

    return docs.select("doc_id", "text", "role").mapInArrow(run, BATCHES)


def word_hashes(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, WORD_BYTES)
    return wide.reshape(-1).view("<u8").astype(np.uint64)


class Batch:
    """A batch's tokens, and its distinct word pairs in order of their numbers."""

    def __init__(self, row):
        """``row``: a batch, or one that has met its answers (with ``words`` for ``vocab``)."""
        self.vocab = word_hashes(row["vocab"]) if "vocab" in row else range(row["words"])
        self.tokens = unpack(row["tokens"], np.uint32)
        self.sizes = np.array(row["sizes"], np.int64)
        self.ends = np.cumsum(self.sizes)
        code = self.tokens.astype(np.int64)
        # The token before a document's first is an end token too.
        code[1:] += self.tokens[:-1].astype(np.int64) * len(self.vocab)
        self.role = np.repeat(np.array(row["roles"], np.int8), self.sizes) if "roles" in row else None
        self.pairs, self.pair = np.unique(code, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        self.first, self.second = (x.astype(np.int32) for x in np.divmod(self.pairs, len(self.vocab)))

    def keys(self) -> np.ndarray:
        """A number of 56 bits for each word, then for each pair: a hash, and a last bit that is set for words."""
        one = mixed(self.vocab ^ np.uint64(0x5851F42D4C957F2D))
        two = mixed(self.vocab[self.first] * np.uint64(0x9E3779B97F4A7C15) + self.vocab[self.second])
        return np.concatenate([one | np.uint64(1 << 8), two & ~np.uint64(1 << 8)]) >> np.uint64(8)

    def counts(self, fold: int) -> np.ndarray:
        own = self.role == fold
        one = np.bincount(self.tokens[own], minlength=len(self.vocab))
        return np.concatenate([one, np.bincount(self.pair[own], minlength=len(self.pairs))])


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


REQUESTS = "batch long, shard int, keys binary, counts binary"


def requests(batches: DataFrame, bits: int) -> DataFrame:
    """What each batch asks of each shard: its keys in order (as differences, without the shard's bits), and
    for each key the counts of both folds."""

    def run(arrows):
        for arrow in arrows:
            for row in arrow.to_pylist():
                batch = Batch(row)
                keys = batch.keys()
                order = np.argsort(keys)
                keys = keys[order]
                counts = np.stack([batch.counts(0)[order], batch.counts(1)[order]])
                cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(56 - bits))
                cuts = np.concatenate([[0], cuts, [len(keys)]])
                keys &= np.uint64((1 << (56 - bits)) - 1)
                full = np.flatnonzero(np.diff(cuts))
                spans = [slice(cuts[s], cuts[s + 1]) for s in full]
                columns = [
                    pa.array(np.full(len(full), row["batch"]), pa.int64()),
                    pa.array(full, pa.int32()),
                    pa.array([pack(np.diff(keys[x], prepend=np.uint64(0))) for x in spans], pa.binary()),
                    pa.array([pack_counts(counts[0, x], counts[1, x]) for x in spans], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["batch", "shard", "keys", "counts"])

    return batches.mapInArrow(run, REQUESTS)


ANSWERS = "batch long, shard int, totals binary, new_words long"


def answers(asked: DataFrame) -> DataFrame:
    """Totals of both folds for each key of each request. ``new_words`` counts a shard's words that were
    learned from, on its first row."""

    def run(arrows):
        held, shard = [], None
        for arrow in arrows:
            for row in arrow.to_pylist():
                if row["shard"] != shard and held:
                    yield answered(held)
                    held = []
                shard = row["shard"]
                held.append(row)
        if held:
            yield answered(held)

    def answered(rows):
        keys = [np.cumsum(unpack(r["keys"], np.uint64), dtype=np.uint64) for r in rows]
        ends = np.cumsum([len(k) for k in keys])[:-1]
        counts = np.concatenate([unpack_counts(r["counts"]) for r in rows], axis=1)
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.stack([np.bincount(at, counts[i], len(distinct)) for i in (0, 1)]).astype(np.uint64)
        words = distinct & np.uint64(1) == 1
        new = [0] * len(rows)
        new[0] = int((words & (totals.sum(axis=0) > 0)).sum())
        columns = [
            pa.array([r["batch"] for r in rows], pa.int64()), pa.array([r["shard"] for r in rows], pa.int32()),
            pa.array([pack_counts(*t) for t in np.split(totals[:, at], ends, axis=1)], pa.binary()), pa.array(new, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["batch", "shard", "totals", "new_words"])

    shards = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return asked.repartitionById(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, ANSWERS)


# What scoring needs of a batch: not its vocabulary, but the totals in its place.
MET = "batch long, doc_ids array<long>, sizes array<int>, words int, tokens binary, totals binary, new_words long, cells array<int>, events array<long>"
MET_ARROW = pa.schema(
    [
        ("batch", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.int32()),
        ("tokens", pa.binary()), ("totals", pa.binary()), ("new_words", pa.int64()), ("cells", pa.list_(pa.int32())), ("events", pa.list_(pa.int64())),
    ]
)


def level(p: np.ndarray) -> np.ndarray:
    """The cell of an estimate: 0 for none, else by its logarithm (1 for the greatest estimates)."""
    with np.errstate(divide="ignore"):
        steps = np.where(p > 0, -np.log(p) * STEPS, 0)
    return np.where(p > 0, np.minimum(steps + 1, CELLS - 1).astype(np.int64), 0)


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else one more than the whole power of two in its count."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def estimates(batch: Batch, totals: np.ndarray, size: float):
    """Per pair: context bucket, estimates of order two and one, and the count of the word."""
    one, two = totals[: len(batch.vocab)].astype(np.float64), totals[len(batch.vocab) :].astype(np.float64)
    context, word = one[batch.first], one[batch.second]
    return bucket(context), two / np.maximum(context, 1), word / max(size, 1.0), word


def met(batches: DataFrame, answered: DataFrame, fold_tokens) -> DataFrame:
    """Each batch with the totals of its keys in its own order, and its held-out events by cell."""

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        batch = Batch(row)
        parts = sorted(right.to_pylist(), key=lambda r: r["shard"])
        in_order = np.concatenate([unpack_counts(r["totals"]) for r in parts], axis=1)
        totals = np.empty_like(in_order)
        totals[:, np.argsort(batch.keys())] = in_order
        cells, events = [], []
        for fold in (0, 1):
            where, two, one, _ = estimates(batch, totals[1 - fold], fold_tokens[1 - fold])
            count = batch.counts(fold)[len(batch.vocab) :]
            seen = count > 0
            cells.append(((where * CELLS + level(two)) * CELLS + level(one))[seen])
            events.append(count[seen])
        cells, at = np.unique(np.concatenate(cells), return_inverse=True)
        events = np.bincount(at, np.concatenate(events), len(cells)).astype(np.int64)
        out = {
            "batch": row["batch"], "doc_ids": row["doc_ids"], "sizes": row["sizes"], "words": len(batch.vocab), "tokens": row["tokens"],
            "totals": pack_counts(*totals), "new_words": sum(r["new_words"] for r in parts), "cells": cells.tolist(), "events": events.tolist(),
        }
        return pa.Table.from_pylist([out], schema=MET_ARROW)

    return batches.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(meet, MET)


def learn_weights(cells, uniform: float) -> np.ndarray:
    """Weights (bucket, order 2 / 1 / 0) from ``(cell, events)``."""
    out = np.full((66, 3), 1 / 3)
    out[0] = (0.0, 0.5, 0.5)
    if not cells:
        return out
    cell, events = (np.array(x, np.int64) for x in zip(*cells))
    where, rest = np.divmod(cell, CELLS * CELLS)
    # An estimate stands at the middle of its cell.
    p = np.zeros((len(cell), 3))
    for i, place in enumerate(np.divmod(rest, CELLS)):
        p[:, i] = np.where(place > 0, np.exp(-(place - 0.5) / STEPS), 0)
    p[:, 2] = uniform
    for _ in range(ITERATIONS):
        share = out[where] * p
        share *= (events / share.sum(axis=1))[:, None]
        # One event more for each order keeps every weight above zero.
        new = np.ones((66, 3))
        np.add.at(new, where, share)
        new[0, 0] = 0
        out = new / new.sum(axis=1, keepdims=True)
    return out


SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def scores(found: DataFrame, weights: np.ndarray, n: int, v: int) -> DataFrame:
    def run(arrows):
        for arrow in arrows:
            for row in arrow.to_pylist():
                batch = Batch(row)
                totals = unpack_counts(row["totals"]).sum(axis=0)
                where, two, one, word = estimates(batch, totals, n)
                w = weights[where]
                model = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (v + 1))
                base = np.log10((word + 0.5) / (n + 0.5 * (v + 1)))
                starts = batch.ends - batch.sizes
                per_doc = [np.add.reduceat(x[batch.pair], starts) for x in ((word > 0).astype(np.int64), base, model)]
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(batch.sizes), *map(pa.array, per_doc)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return found.mapInArrow(run, SCORES)


def score(df: DataFrame, learn, key="doc_id", text="text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` of every row, learning from the rows
    where the boolean column ``learn`` is true."""
    fold = F.pmod(F.xxhash64(F.col(key)), F.lit(2)).cast("int")
    docs = df.select(
        F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.when(learn, fold).otherwise(-1).alias("role"),
    )
    batches = written(batches_of(docs), "lm-batches")
    sizes = batches.select(F.explode(F.arrays_zip("roles", "sizes")).alias("d")).groupBy("d.roles").agg(F.sum("d.sizes")).collect()
    sizes = {role: int(tokens) for role, tokens in sizes}
    folds = (sizes.get(0, 0), sizes.get(1, 0))
    n = sum(folds)
    bits = max(LEAST_SHARD_BITS, (sum(sizes.values()) // SHARD_TOKENS).bit_length())
    found = written(met(batches, answers(requests(batches, bits)), folds), "lm-met")
    v = found.agg(F.sum("new_words")).first()[0] or 0
    cells = found.select(F.explode(F.arrays_zip("cells", "events")).alias("c")).groupBy("c.cells").agg(F.sum("c.events")).collect()
    weights = learn_weights([tuple(c) for c in cells], 1 / (v + 1))
    return scores(found, weights, n, v).withColumn("train_tokens", F.lit(n).cast("long"))
