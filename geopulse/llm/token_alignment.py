"""Alignment of two tokenizers of one text by galloping intersection of token ends.

Tokenizer A is a byte-level BPE of the tokenizers library, which gets a blank and the text; tokenizer B is a
sentencepiece model, which puts that blank ahead by itself. Both cut the same bytes, so a token of either is a
range of byte offsets and the list of a text's token ends says all. The shorter list of ends drives the
search: each end is looked for in the longer list by steps that double, then by bisection inside the last
step. Ends that both lists have cut the tokens into groups. The tokens of B that overlap a token of A are a
range: from the number of B's ends at or before its start to the number of B's starts before its end.

A text is worked on in units: a unit begins at a blank or line end that follows anything but white space. No
token of A or B goes over such a place (A's pattern ends a piece there, and no piece of B has a blank inside or
a line end but as a byte; :class:`Aligner` checks that when it loads the files), so both lists have
an end there and the alignment of a unit holds wherever it stands. The distinct units of a batch of documents are
tokenized once and aligned together, as one long text in arrays. Units of earlier batches are kept in a cache
of bounded bytes.

How many links hold a pair of ids linked in the whole corpus takes two passes. The first packs each batch into one
row (for each document its sums and its units' numbers, for each unit its pairs' numbers) beside a row for each
pair of the batch with its count; Spark adds the counts up. In the second each batch meets the totals of its
pairs, in the order of their numbers, and sums them over the documents; no text is read again. Nothing is
broadcast but the greatest count of each id of B, which has a row for each id of the vocabulary at most. There is
no limit on pairs or links.

Results for edge cases: a null or empty text, and one whose bytes B does not give back (such as one with U+2581),
has no tokens: zeros, and the empty text in place of the digest. Special tokens' strings in a text are plain
text. Very long texts are whole. Repeated rows and keys are documents of their own. Null keys stay. Extra
columns are ignored. An empty table gives an empty result.
"""

import hashlib
import os
import re
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.byte_bpe import byte_characters
from geopulse.llm.common import free, keyed_text, written

# Documents, units, and bytes of distinct units at which a batch is full.
BATCH, BATCH_UNITS, BATCH_BYTES = 16384, 1_000_000, 16 << 20
# White space as Python has it includes all that the pattern of A has, so no unit begins too early.
UNIT = re.compile(r"[ \n]\s*\S*(?:[^\S \n]\s*\S*)*")
# The same for a text without other white space, and how to tell.
PLAIN_UNIT, OTHER_SPACE = re.compile(r"[ \n]+[^ \n]*"), re.compile(r"[^\S \n]")
CACHE_BYTES, CACHED_UNIT = 96 << 20, 48
# Units that are tokenized as one text.
JOINED = 128
# Ids of B are below this, so that a pair of ids is one number.
PAIR_BITS = 20


def gallop(values: np.ndarray, ends: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each value the first place from its start on whose end is not below it.

    All values gallop at once: steps from the start double until an end is not below the value, then the last
    step is halved until one place is left.
    """
    found = start.copy()
    todo = np.flatnonzero(ends[start] < values)
    low, high = start[todo], np.zeros(len(todo), np.int64)
    at, step = np.arange(len(todo)), 1
    while len(at):
        probe = np.minimum(low[at] + step, len(ends) - 1)
        below = ends[probe] < values[todo[at]]
        high[at] = probe
        at = at[below]
        low[at] = probe[below]
        step *= 2
    while True:
        wide = np.flatnonzero(high - low > 1)
        if not len(wide):
            break
        middle = (low[wide] + high[wide]) // 2
        below = ends[middle] < values[todo[wide]]
        low[wide[below]] = middle[below]
        high[wide[~below]] = middle[~below]
    found[todo] = high
    return found


def common_ends(a: np.ndarray, b: np.ndarray, a_from: np.ndarray, b_from: np.ndarray):
    """Places ``i, j`` with ``a[i] == b[j]``, of two ascending lists that end alike.

    ``a_from`` and ``b_from`` are the same known ends in both lists, ascending: a search starts behind the
    last one before its value.
    """
    if len(a) > len(b):
        j, i = common_ends(b, a, b_from, a_from)
        return i, j
    marks = a_from + 1
    behind = np.searchsorted(marks, np.arange(len(a)), "right")
    start = np.concatenate([[0], b_from + 1])[behind]
    at = gallop(a, b, start)
    i = np.flatnonzero(b[at] == a)
    return i, at[i]


class Alignment:
    """Distinct units aligned as one text: their tokens, groups and links, unit after unit."""

    def __init__(self, a, a_sizes, b, b_sizes, bytes_a, bytes_b):
        """Ids of both in a row, how many each unit has, and the bytes of each id."""
        self.a, self.b = a, b
        self.a_at, self.b_at = (np.concatenate([[0], np.cumsum(s)]).astype(np.int64) for s in (a_sizes, b_sizes))
        self.a_ends, self.b_ends = np.cumsum(bytes_a[a]), np.cumsum(bytes_b[b])
        filled = a_sizes > 0
        last_a, last_b = (at[1:][filled] - 1 for at in (self.a_at, self.b_at))
        if len(a):
            self.cut_a, self.cut_b = common_ends(self.a_ends, self.b_ends, last_a, last_b)
        else:
            self.cut_a = self.cut_b = np.zeros(0, np.int64)
        # How many groups end before each unit.
        self.groups_at = np.searchsorted(self.cut_a, self.a_at, "left")
        a_starts, b_starts = self.a_ends - bytes_a[a], self.b_ends - bytes_b[b]
        low, high = np.searchsorted(self.b_ends, a_starts, "right"), np.searchsorted(b_starts, self.a_ends, "left")
        count = high - low
        first = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]])[: len(count)], count)
        of_b = first + np.arange(len(first))
        self.pairs = np.repeat(a.astype(np.int64), count) << PAIR_BITS | b[of_b]
        self.links_at = np.concatenate([[0], np.cumsum(count)])[self.a_at]

    def sums(self) -> np.ndarray:
        """Tokens of both, groups and links of each unit."""
        return np.stack([np.diff(x) for x in (self.a_at, self.b_at, self.groups_at, self.links_at)], axis=1)

    def texts(self, table) -> list[str]:
        """Each unit's groups as text, every group with its end mark; ``table`` spells an id with its mark."""
        n_a, n_b, n = len(self.a), len(self.b), len(table) // 3
        # Tokens of A stand behind those of B of earlier groups, tokens of B behind those of A of their own group.
        last_a, last_b = np.zeros(n_a, np.int64), np.zeros(n_b, np.int64)
        last_a[self.cut_a], last_b[self.cut_b] = 1, 1
        ends_a, ends_b = self.cut_a + 1, self.cut_b + 1
        behind_a = np.concatenate([[0], ends_b])[np.cumsum(last_a) - last_a]
        behind_b = ends_a[np.cumsum(last_b) - last_b] if n_b else np.zeros(0, np.int64)
        marked = np.zeros(n_a + n_b, np.int64)
        marked[np.arange(n_a) + behind_a] = self.a + n * last_a
        marked[np.arange(n_b) + behind_b] = self.b + 2 * n * last_b
        spelt = list(map(table.__getitem__, marked.tolist()))
        at = (self.a_at + self.b_at).tolist()
        return ["".join(spelt[x:y]) for x, y in zip(at, at[1:])]


class Places(dict):
    """Numbers for units, in the order they come."""

    def __missing__(self, unit):
        self[unit] = n = len(self)
        return n


class Aligner:
    """Both tokenizers, and the tokens of units that came before."""

    def __init__(self, path_a: str, path_b: str):
        # One thread a worker: Spark already runs a worker for each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.tool_a = Tokenizer.from_file(path_a)
        self.tool_a.encode_special_tokens = True
        byte_of = {c: i for i, c in enumerate(byte_characters())}
        vocab = self.tool_a.get_vocab()
        # An added token may be spelt with any characters; no text is encoded to it.
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else b""
        self.tool_b = tool = SentencePieceProcessor(model_file=path_b)
        self.bytes_b = []
        for i in range(tool.vocab_size()):
            piece = tool.id_to_piece(i)
            if tool.is_byte(i):
                self.bytes_b.append(bytes([int(piece[3:-1], 16)]))
            elif tool.is_control(i) or tool.is_unknown(i) or tool.is_unused(i):
                self.bytes_b.append(b"")
            else:
                if "▁" in piece.lstrip("▁") or "\n" in piece:
                    raise ValueError(f"piece {piece!r} goes over the end of a unit")
                self.bytes_b.append(piece.replace("▁", " ").encode())
        if len(self.bytes_b) > 1 << PAIR_BITS:
            raise ValueError("too many ids for a pair in one number")
        self.sizes_a, self.sizes_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.blank = tool.piece_to_id("▁")
        # Every id with the mark between tokens, at the end of A's part of a group, and at the end of a group.
        ids = range(max(len(self.bytes_a), len(self.bytes_b)))
        self.table = [f"{i}{mark}" for mark in ",|;" for i in ids]
        self.cache, self.held = {}, 0

    def tokens_b(self, units) -> list[list[int]]:
        """Ids of B; the library puts a blank ahead, which stands for a unit's own or is taken off.

        None where that blank went into another token.
        """
        got = self.tool_b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        for i, unit in enumerate(units):
            if unit[0] != " ":
                got[i] = got[i][1:] if got[i][0] == self.blank else None
            elif len(unit) == 1:
                got[i] = [self.blank]
        return got

    def one_by_one(self, units) -> dict:
        """For each unit the ids of both as bytes of 32-bit integers, or nothing if they do not give its bytes."""
        made = {}
        tokens_a = [t.ids for t in self.tool_a.encode_batch_fast(units, add_special_tokens=False)]
        for unit, a, b in zip(units, tokens_a, self.tokens_b(units)):
            raw = unit.encode()
            same = b is not None and b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            made[unit] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if same else ()
        return made

    def in_a_row(self, units) -> dict:
        """The same for units that end with anything but white space: joined, they are tokenized as each by itself."""
        made, parts = {}, [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        texts = ["".join(p) for p in parts]
        tokens_a = [t.ids for t in self.tool_a.encode_batch_fast(texts, add_special_tokens=False)]
        for part, text, *tokens in zip(parts, texts, tokens_a, self.tokens_b(texts)):
            raw, cuts = text.encode(), []
            ends = np.cumsum([len(u) if u.isascii() else len(u.encode()) for u in part])
            for ids, spell, sizes in zip(tokens, (self.bytes_a, self.bytes_b), (self.sizes_a, self.sizes_b)):
                if ids is None or b"".join(map(spell.__getitem__, ids)) != raw:
                    break
                at = np.searchsorted(np.cumsum(sizes[ids]), ends) + 1
                cuts.append((np.array(ids, "<u4").tobytes(), (4 * at).tolist()))
            if len(cuts) < 2:
                made.update(self.one_by_one(part))
                continue
            (a, a_at), (b, b_at) = cuts
            for unit, x, y, u, v in zip(part, [0, *a_at], a_at, [0, *b_at], b_at):
                made[unit] = a[x:y], b[u:v]
        return made

    def tokenized(self, units, often=None) -> list:
        """For each unit the ids of both as bytes of 32-bit integers, or nothing if they do not give its bytes.

        ``often`` tells which units are worth keeping.
        """
        found = list(map(self.cache.get, units))
        new = [u for u, got in zip(units, found) if got is None]
        if not new:
            return found
        open_ended = [u for u in new if u[-1].isspace()]
        made = self.in_a_row([u for u in new if not u[-1].isspace()] if open_ended else new)
        if open_ended:
            made |= self.one_by_one(open_ended)
        for i, unit in enumerate(units):
            if found[i] is None:
                found[i] = got = made[unit]
                if (often is None or often[i]) and len(unit) <= CACHED_UNIT and self.held < CACHE_BYTES:
                    # Four objects of some 50 bytes, a place in the dictionary, and the texts themselves.
                    self.held += 320 + 2 * len(unit) + sum(map(len, got))
                    self.cache[unit] = got
        return found

    def align(self, units, often=None):
        """The alignment of distinct units, and which of them cannot be aligned (they are empty in it)."""
        tokens = self.tokenized(units, often)
        bad = np.array([not t for t in tokens], bool)
        none = (b"", b"")
        a, b = zip(*[t or none for t in tokens]) if tokens else ((), ())
        sizes_a, sizes_b = (np.fromiter(map(len, x), np.int64, len(x)) // 4 for x in (a, b))
        a, b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
        return Alignment(a, sizes_a, b, sizes_b, self.sizes_a, self.sizes_b), bad


@lru_cache(maxsize=2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def vocabularies(a="byte_bpe_50k.json", b="piece_bpe_32k.model"):
    """Paths of two installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path(a), public_tokenizers.path(b)


def units_of(text: str) -> list[str]:
    if not text:
        return []
    return (UNIT if OTHER_SPACE.search(text) else PLAIN_UNIT).findall(" " + text)


class Batch:
    """Documents cut into numbered units."""

    def __init__(self):
        self.keys, self.units, self.places, self.cut, self.size = [], [], Places(), 0, 0

    def add(self, key, text: str):
        before, units = len(self.places), units_of(text)
        self.keys.append(key)
        self.units.append(np.fromiter(map(self.places.__getitem__, units), np.int32, len(units)))
        self.cut += len(units)
        if len(self.places) > before:
            self.size += len(text)

    def full(self) -> bool:
        return len(self.keys) >= BATCH or self.cut >= BATCH_UNITS or self.size >= BATCH_BYTES

    def settled(self, tool: Aligner):
        """The alignment of the units; documents with a unit that cannot be aligned lose all of theirs."""
        times = np.bincount(np.concatenate(self.units), minlength=len(self.places)) if self.units else np.zeros(0)
        found, bad = tool.align(list(self.places), (times > 1).tolist())
        self.units = [u[:0] if bad[u].any() else u for u in self.units]
        return found


def batches_of(batches):
    """Keys and texts of Arrow batches as full :class:`Batch` objects."""
    now = Batch()
    for batch in batches:
        for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            now.add(key, text)
            if now.full():
                yield now
                now = Batch()
    if now.keys:
        yield now


def groups(df: DataFrame, path_a: str, path_b: str, key="doc_id", text="text") -> DataFrame:
    """``doc_id, groups``: for each group its first and last byte offset in blank and text, and the ids of both."""
    kind = df.schema[key].dataType.simpleString()
    cell = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches):
        for batch in batches:
            now = Batch()
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                now.add(k, t)
            found = now.settled(aligner(path_a, path_b))
            cut_a, cut_b = np.concatenate([[0], found.cut_a + 1]), np.concatenate([[0], found.cut_b + 1])
            byte_at = np.concatenate([[0], found.a_ends])[cut_a]
            rows = []
            for units in now.units:
                row, at = [], 0
                for g in (g for u in units for g in range(found.groups_at[u], found.groups_at[u + 1])):
                    size = int(byte_at[g + 1] - byte_at[g])
                    ids = found.a[cut_a[g] : cut_a[g + 1]].tolist(), found.b[cut_b[g] : cut_b[g + 1]].tolist()
                    row.append({"start": at, "end": at + size, "a": ids[0], "b": ids[1]})
                    at += size
                rows.append(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(cell))], ["doc_id", "groups"])

    schema = f"doc_id {kind}, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>"
    return keyed_text(df, key, text).mapInArrow(run, schema)


def packed_array(values: np.ndarray) -> bytes:
    """Compressed bytes; byte planes one after another, since the upper ones hardly vary."""
    return zlib.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


def packed(df: DataFrame, path_a: str, path_b: str, key="doc_id", text="text") -> DataFrame:
    """For each batch a row of its documents, and a row ``pair, n`` for each pair of ids that they link.

    ``batch`` tells the batches of a table apart. In the documents' row ``keys, digests`` are lists, ``sums`` has
    four numbers for each document, ``sizes`` and ``units`` its units, ``link_sizes`` and ``links`` each unit's links as
    numbers of the batch's pairs in ascending order.
    """
    rows = keyed_text(df, key, text).select(F.spark_partition_id().cast("long").alias("task"), "doc_id", "text")
    names = ["batch", "keys", "digests", "sums", "sizes", "units", "link_sizes", "links", "pair", "n"]
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        first = next(batches, None)
        if first is None:
            return
        task, key_type = first.column(0)[0].as_py() if first.num_rows else 0, first.column(1).type

        def all_batches():
            yield first
            yield from batches

        tool = aligner(path_a, path_b)
        for number, now in enumerate(batches_of(all_batches())):
            found, batch = now.settled(tool), (task << 32) + number
            each, texts = found.sums(), found.texts(tool.table)
            sums = np.array([each[u].sum(axis=0) for u in now.units], np.int64).reshape(-1, 4)
            digests = [hashlib.sha256("".join([texts[i] for i in u])[:-1].encode()).hexdigest() if len(u) else "" for u in now.units.copy()]
            flat = np.concatenate(now.units)
            times = np.bincount(flat, minlength=len(now.places))
            sizes = np.diff(found.links_at)
            pairs, links = np.unique(found.pairs, return_inverse=True)
            n = np.bincount(links, np.repeat(times, sizes).astype(float), len(pairs)).astype(np.int64)
            blobs = [packed_array(x) for x in (sums.ravel(), np.array(list(map(len, now.units))), flat, sizes, links)]
            lists = [pa.array([now.keys], pa.list_(key_type)), pa.array([digests], pa.list_(pa.string()))]
            one = [pa.array([batch]), *lists, *[pa.array([x], pa.binary()) for x in blobs], pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
            yield pa.RecordBatch.from_arrays(one, names)
            # Units of documents that lost them may leave pairs that nobody has.
            none = [pa.nulls(len(pairs), x.type) for x in one[1:8]]
            counted = [pa.array(np.full(len(pairs), batch)), *none, pa.array(pairs), pa.array(n)]
            yield pa.RecordBatch.from_arrays(counted, names)

    blobs = ", ".join(f"{c} binary" for c in names[3:8])
    return rows.mapInArrow(run, f"batch long, keys array<{kind}>, digests array<string>, {blobs}, pair long, n long")


def pair_counts(counts: DataFrame) -> DataFrame:
    """``pair, a, b, count, best`` from ``pair, count``: both ids, and whether none of its B id has more."""
    a, b = F.shiftright("pair", PAIR_BITS).cast("int"), F.col("pair").bitwiseAND((1 << PAIR_BITS) - 1).cast("int")
    counts = counts.select("pair", a.alias("a"), b.alias("b"), "count")
    # At most one row for each id of B's vocabulary.
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    return counts.join(F.broadcast(most), "b").select("pair", "a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


FIELDS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def added(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of so many values each."""
    ends = np.concatenate([[0], np.cumsum(values)])
    at = np.concatenate([[0], np.cumsum(sizes)])
    return ends[at[1:]] - ends[at[:-1]]


def report(df: DataFrame, path_a: str, path_b: str, key="doc_id", text="text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row."""
    kind = df.schema[key].dataType.simpleString()
    rows = written(packed(df, path_a, path_b, key, text), "alignment-batches")
    pairs = rows.where("pair IS NOT NULL").select("batch", "pair", "n")
    counts = written(pairs.groupBy("pair").agg(F.sum("n").alias("count")), "alignment-counts")
    totals = pairs.select("batch", "pair").join(pair_counts(counts).select("pair", "count", "best"), "pair")
    docs = rows.where("pair IS NULL").drop("pair", "n")
    docs = docs.select("*", *[F.lit(None).cast(k).alias(c) for c, k in (("pair", "long"), ("count", "long"), ("best", "boolean"))])
    blank = [F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in docs.columns[1:8]]
    totals = totals.select("batch", *blank, "pair", "count", "best")
    # The documents' row first (its pair is null), then the totals in the order of the pairs' numbers.
    met = docs.unionByName(totals).repartition("batch").sortWithinPartitions("batch", "pair")
    names = ["doc_id", *FIELDS, "groups_sha256"]

    def run(batches):
        row, counts, best = None, [], []

        def summed():
            keys, digests, sums, sizes, units, link_sizes, links = (x[0] for x in row)
            sums, sizes, units, link_sizes, links = map(unpacked, (x.as_py() for x in (sums, sizes, units, link_sizes, links)))
            columns = list(sums.reshape(-1, 4).T)
            for values in (best, counts):
                values = np.concatenate(values) if values else np.zeros(0, np.int64)
                columns.append(added(added(values[links], link_sizes)[units], sizes))
            return pa.RecordBatch.from_arrays([keys.values, *map(pa.array, columns), digests.values], names)

        for batch in batches:
            heads = np.flatnonzero(batch.column(8).is_null().to_numpy(zero_copy_only=False)).tolist()
            for low, high in zip([0, *heads], [*heads, batch.num_rows]):
                if low in heads and low < high:
                    if row is not None:
                        yield summed()
                    row, counts, best = [batch.column(i).slice(low, 1) for i in range(1, 8)], [], []
                    low += 1
                counts.append(batch.column(9).slice(low, high - low).to_numpy())
                best.append(batch.column(10).slice(low, high - low).to_numpy(zero_copy_only=False).astype(np.int64))
        if row is not None:
            yield summed()

    schema = f"doc_id {kind}, " + ", ".join(f"{f} long" for f in FIELDS) + ", groups_sha256 string"
    return met.mapInArrow(run, schema)
