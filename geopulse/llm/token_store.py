"""Token ids as ORC files: integer run lengths, row indexes, and Bloom filters on document ids.

Texts are encoded with the tokenizers library and a vocabulary file whose path is a parameter; each
document ends with ``end_id``. Rows are dealt by ranges of the document id, sorted within a task, encoded
and written as the sorted rows stream by, so ids ascend over the parts of a store. A row has the id, the
ids of its text as a list of integers, how many they are, its part, and how many ids stand before it in the
part. Where a document begins in the whole sequence of ids follows from the totals of the parts, one
small row for each.

The files are plain ORC: lists of integers are stored as run lengths, stripes are read by different tasks,
and statistics of stripes and row groups (``stride`` rows) with a Bloom filter on the document id let a
look-up skip what cannot hold the ids asked for.

A text is cut into pieces that no token goes across; frequent pieces are kept in a Python worker, in a cache
whose bytes are bounded, and the others of some texts are encoded together. ``<|endoftext|>`` and other added tokens written in a text are encoded as the library
does by default.

Results for edge cases: a null or empty text has only ``end_id``. Very long texts are whole. A null id is
the least. Rows with one id are ordered by a hash of the text, then as they come, and each is a document
of its own; a hot id is spread over tasks. Extra columns are ignored. An empty table gives an empty store.
"""

import os
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopulse.llm.common import keyed_text
from geopulse.session import scratch_path

END_ID = 2
STRIPE_BYTES = 8 << 20
# Rows of a row group: what a look-up reads at least.
STRIDE = 1000
# Bytes of pieces and ids that a worker keeps, and the longest piece kept.
CACHE_BYTES, CACHED_PIECE = 96 << 20, 64
# Characters of texts that are looked up together, and pieces that are encoded as one text.
STEP_CHARS, JOINED = 300_000, 256
# Rows that are encoded and handed on together.
ROWS = 500
# A word that stands between pieces in such a text.
MARK = "\x01"
# Words of any text, and white space that Python cuts at and the vocabulary need not.
WORD, ODD_SPACE = re.compile(r"[^ \t\n\r]+"), re.compile(r"[^\S \t\n\r]")
# What the vocabulary cuts a lower-case text into: its own pattern, written out for characters below U+0250, whose normal
# form is themselves. Texts with any other character, or with what may be an added token, are cut into words.
LETTERS, DIGITS, SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
PIECE = re.compile(f"[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[{DIGITS}]|[^{LETTERS}{DIGITS}{SPACES}]+")
OTHER = re.compile("[\x1c-\x1f\u0130\u0250-\U0010ffff]|<\\|")


def pieces_of(text: str) -> list[str]:
    """A text cut where no token goes across, white space left out."""
    if not OTHER.search(text):
        return PIECE.findall(text.lower())
    return WORD.findall(text) if ODD_SPACE.search(text) else text.split()


class Encoder:
    """Ids of pieces, as bytes of little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        # One thread a worker: Spark already runs a worker for each core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        mark = self.ids([MARK])[0]
        # Where the mark is more than one id, words are encoded one by one.
        self.mark = mark[0] if len(mark) == 1 else None
        self.cache, self.held = {}, 0

    def ids(self, texts) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def learned(self, words) -> dict[str, bytes]:
        """Ids of distinct words."""
        plain = [w for w in words if MARK not in w] if self.mark is not None else []
        found = {}
        parts = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        for part, ids in zip(parts, self.ids([f" {MARK} ".join(p) for p in parts])):
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(ids == self.mark)
            if len(ends) != len(part) - 1:
                # A word gives the mark's id as well.
                found.update(zip(part, (np.array(x, "<u4").tobytes() for x in self.ids(part))))
                continue
            data, starts, ends = ids.tobytes(), [0, *(4 * ends + 4).tolist()], [*(4 * ends).tolist(), 4 * len(ids)]
            for word, x, y in zip(part, starts, ends):
                found[word] = data[x:y]
        others = [w for w in words if w not in found]
        found.update(zip(others, (np.array(x, "<u4").tobytes() for x in self.ids(others))))
        return found

    def encode(self, texts) -> list[bytes]:
        """Ids of some texts."""
        cut, cache = [pieces_of(t) for t in texts], self.cache
        # The pieces of a step are few against the cache, and each is looked up in it once.
        own = dict.fromkeys(chain.from_iterable(cut))
        found = list(map(cache.get, own))
        new = [p for p, ids in zip(own, found) if ids is None]
        own = dict(zip(own, found))
        made = self.learned(new) if new else {}
        own.update(made)
        out = [b"".join(map(own.__getitem__, pieces)) for pieces in cut]
        for piece, ids in made.items():
            # A dictionary entry costs some 250 bytes besides its texts.
            size = 250 + 2 * len(piece) + len(ids)
            if len(piece) <= CACHED_PIECE and self.held + size <= CACHE_BYTES:
                self.held += size
                cache[piece] = ids
        return out


def steps(texts):
    """The texts in runs of about ``STEP_CHARS``."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= STEP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def vocabulary(name="word_bpe_49k.json") -> str:
    """Path of an installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encoded(df: DataFrame, vocab: str, key="doc_id", text="text", end_id=END_ID) -> DataFrame:
    """``part, doc_id, before, n_tokens, ids`` in ascending order of the id over the parts."""
    rows = keyed_text(df, key, text).select("doc_id", "text", F.monotonically_increasing_id().alias("tie"))
    # Only rows of one id are told apart by their texts; the place a row comes from splits equal rows.
    order = [F.col("doc_id"), F.xxhash64("text"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    names = ["part", "doc_id", "before", "n_tokens", "ids"]

    def run(batches):
        tool, before, end = encoder(vocab), 0, np.array([end_id], "<u4").tobytes()
        # Small batches: what is made of a few texts goes on before the next are looked at.
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            lists = [ids + end for step in steps(batch.column(2).to_pylist()) for ids in tool.encode(step)]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists)) // 4
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            ends = before + offsets[1:]
            values = pa.array(np.frombuffer(b"".join(lists), "<i4"))
            ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            columns = [batch.column(0), batch.column(1), pa.array(ends - sizes), pa.array(sizes), ids]
            yield pa.RecordBatch.from_arrays(columns, names)
            before = int(ends[-1]) if len(ends) else before

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"part int, doc_id {kind}, before long, n_tokens long, ids array<int>")


def write_tokens(df: DataFrame, path, vocab: str, key="doc_id", text="text", end_id=END_ID, stripe=STRIPE_BYTES, stride=STRIDE):
    """A store of token ids at ``path``."""
    writer = encoded(df, vocab, key, text, end_id).write.mode("overwrite").format("orc")
    writer = writer.option("orc.stripe.size", stripe).option("orc.row.index.stride", stride)
    writer = writer.option("orc.rows.between.memory.checks", stride).option("orc.create.index", "true").option("orc.bloom.filter.columns", "doc_id")
    writer.option("orc.bloom.filter.fpp", "0.01").save(path)


def read_tokens(spark: SparkSession, path) -> DataFrame:
    """Rows of a store; files are read by the schema they carry, stripe by stripe."""
    return spark.read.orc(path)


def find_tokens(spark: SparkSession, path, ids) -> DataFrame:
    """The documents of a short list of ids: the scan skips stripes and row groups without them."""
    return read_tokens(spark, path).where(F.col("doc_id").isin(list(ids)))


def part_starts(store: DataFrame) -> DataFrame:
    """``part, start``: how many ids stand in earlier parts. One row for each part.

    Only the part, the count and the place are read, not the ids.
    """
    totals = store.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("start"))


def summary(store: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document of a store, from its files."""
    names = ["part", "doc_id", "before", "n_tokens", "ids_crc32"]

    def run(batches):
        for batch in batches:
            ids = batch.column(3)
            values = ids.values.to_numpy(zero_copy_only=False).view("<u4")
            ends = ids.offsets.to_numpy().tolist()
            sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(ends, ends[1:])]
            sizes = np.diff(ends).astype(np.int64)
            columns = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = store.schema["doc_id"].dataType.simpleString()
    rows = store.select("part", "doc_id", "before", "ids")
    rows = rows.mapInArrow(run, f"part int, doc_id {kind}, before long, n_tokens long, ids_crc32 long")
    rows = rows.join(part_starts(store), "part")
    return rows.select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def written_and_read(df: DataFrame, vocab: str, key="doc_id", text="text") -> DataFrame:
    """A store of the table's texts in the shared folder, and what its files say of every document."""
    path = scratch_path(df.sparkSession, "tokens")
    write_tokens(df, path, vocab, key, text)
    return summary(read_tokens(df.sparkSession, path))
