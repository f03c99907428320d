"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range. Its size follows the
document, so the sketches of two documents of very unequal length hold the same sample of what they
share: containment and likeness are ratios of set sizes, and the sketch of a union is the union of
the sketches. The fraction is the whole range: most documents have too few shingles for a sample of them
to tell their likeness, so all are kept, and ratios are exact but for equal hashes of unequal shingles.
Beside the sample a fingerprint names the least hash of all, which answers (by equality) where a thinner
fraction (``fraction_bits`` above 0) leaves both samples empty.

A shingle is five words in a row; a text of fewer words is one shingle of all its words. Words are
as in ``common.WORD``.

Results for edge cases: a null or empty text, or one without a word, has the fingerprint ``-``, which
is like itself (1) and unlike all others (0). Equal texts have equal fingerprints. Very long texts are
read whole. Rows are ordered by key (null first) and then text, so repeated keys have a defined order;
a single row is its own next row; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
# One hash in 2 ** FRACTION_BITS is kept: all.
FRACTION_BITS = 0
# Characters of fingerprints in one batch.
STEP = 1 << 24
WORDS_KEPT = 200_000


class WordHashes(dict):
    """Hash of a word as eight bytes; words seen stay until there are too many."""

    def __missing__(self, word):
        out = self[word] = xxhash.xxh64_digest(word)
        return out


class Sketcher:
    """Sketches of texts; hashes of frequent words are kept between texts."""

    def __init__(self, shingle=SHINGLE, fraction_bits=FRACTION_BITS):
        self.shingle, self.limit = shingle, np.uint64((1 << (64 - fraction_bits)) - 1)
        self.seen = WordHashes()

    def word_hashes(self, data: bytes) -> np.ndarray:
        """A hash for each word in order. Bytes split at the same white space as the word pattern,
        and no byte of a longer character is white space."""
        if len(self.seen) > WORDS_KEPT:
            self.seen.clear()
        return np.frombuffer(b"".join(map(self.seen.__getitem__, data.split())), ">u8").astype(np.uint64)

    def of_words(self, word: np.ndarray):
        """The sketch of a sequence of word hashes: (least shingle hash or None, kept hashes)."""
        if not len(word):
            return None, np.zeros(0, np.uint64)
        size = min(self.shingle, len(word))
        count = len(word) - size + 1
        out = word[:count].copy()
        for i in range(1, size):
            # A polynomial of the word hashes, mixed below; the order of words counts.
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += word[i : count + i]
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            out ^= out >> np.uint64(shift)
            out *= np.uint64(factor)
        return int(out.min()), np.unique(out[out <= self.limit])

    def sketch(self, data: bytes):
        return self.of_words(self.word_hashes(data))


def fingerprint(sketch) -> str:
    """``-`` for no word, else the least hash, and the kept hashes, in hex."""
    least, kept = sketch
    return "-" if least is None else f"{least:016x}:{kept.astype('>u8').tobytes().hex()}"


def parse(text: str):
    """The sketch of a fingerprint."""
    if text == "-":
        return None, np.zeros(0, np.uint64)
    least, _, kept = text.partition(":")
    return int(least, 16), np.frombuffer(bytes.fromhex(kept), ">u8").astype(np.uint64)


def merge(a, b):
    """The sketch of both documents' shingles together."""
    least = min((x for x in (a[0], b[0]) if x is not None), default=None)
    return least, np.union1d(a[1], b[1])


def likeness(a, b) -> float:
    """Estimated Jaccard similarity."""
    if a[0] is None or b[0] is None:
        return float(a[0] is b[0])
    shared = len(np.intersect1d(a[1], b[1], assume_unique=True))
    union = len(a[1]) + len(b[1]) - shared
    return shared / union if union else float(a[0] == b[0])


def containment(a, b) -> float:
    """Estimated share of a's shingles that b has."""
    if a[0] is None or b[0] is None:
        return float(a[0] is None)
    if not len(a[1]):
        return float(a[0] == b[0])
    return len(np.intersect1d(a[1], b[1], assume_unique=True)) / len(a[1])


def fingerprints(df: DataFrame, key="doc_id", text="text", shingle=SHINGLE, fraction_bits=FRACTION_BITS) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        tool = Sketcher(shingle, fraction_bits)
        for batch in batches:
            at, prints, size = 0, [], 0
            for t in batch.column(1).to_pylist():
                prints.append(fingerprint(tool.sketch(t.encode())))
                size += len(prints[-1])
                if size >= STEP or at + len(prints) == batch.num_rows:
                    keys = batch.column(0).slice(at, len(prints))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(prints, pa.string())], ["doc_id", "fingerprint"])
                    at, prints, size = at + len(prints), [], 0

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def place_among(value, cuts) -> F.Column:
    """How many of the sorted ``cuts`` are at or below a value, by halving."""
    steps = [1 << i for i in reversed(range(len(cuts).bit_length()))]
    if not steps:
        return F.lit(0)
    table = F.lit(cuts).cast("array<long>")

    def step(at, width):
        fits = (at + width <= len(cuts)) & (F.element_at(table, F.least(at + width, F.lit(len(cuts)))) <= value)
        return F.when(fits, at + width).otherwise(at)

    return F.aggregate(F.lit(steps), F.lit(0), step)


def ordered_slices(df: DataFrame, key: str, text: str, slices: int) -> DataFrame:
    """Rows dealt to ``slices`` ranges of the key, each range followed by a copy of the row that
    comes next in order: ``slice, tail, doc_id, text``.

    The cuts between ranges are quantiles of the keys. They and the first key of each range are all
    that the driver sees: ``slices`` numbers. All rows of one key are in one range.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    shares = [i / slices for i in range(1, slices)]
    cuts = rows.select("doc_id").approxQuantile("doc_id", shares, 0.2 / slices) if shares else []
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(place_among(F.col("doc_id"), sorted({int(c) for c in cuts})))
    rows = rows.withColumn("slice", place)
    least = F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id"))
    first = [(r["slice"], r["least"]["doc_id"]) for r in rows.groupBy("slice").agg(least.alias("least")).collect()]
    first.sort(key=lambda r: r[0])
    # The first row of a range is copied to the range before it, that of the first range to the last.
    copies = [(part, at, first[i - 1][0]) for i, (part, at) in enumerate(first)]
    copies = spark.createDataFrame(copies, "slice int, first long, to int")
    same = (rows["slice"] == copies["slice"]) & rows["doc_id"].eqNullSafe(copies["first"])
    tails = rows.join(F.broadcast(copies), same).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    tails = tails.select(F.col("to").alias("slice"), F.lit(True).alias("tail"), "doc_id", "text")
    return rows.select("slice", F.lit(False).alias("tail"), "doc_id", "text").unionByName(tails)


def edited(text: str, following: str) -> str:
    """The last quarter (in code points, rounded down) replaced by as much of the next text's start."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edited_word_hashes(tool: Sketcher, text: str, word, following: str, next_word) -> np.ndarray:
    """The word hashes of ``edited(text, following)``, from those of the two texts.

    Only the word where the texts meet and the last one need to be hashed anew.
    """
    cut = len(text) // 4
    head, tail = text[: len(text) - cut].encode(), following[:cut].encode()
    heads, tails = head.split(), tail.split()
    n_head, n_tail = len(heads), len(tails)
    if n_head < 2 or n_tail < 2:
        return tool.word_hashes(head + tail)
    if not head[-1:].isspace() and not tail[:1].isspace():
        middle, used = heads[-1] + tails[0], 1
    else:
        middle, used = heads[-1], 0
    ends = [tool.word_hashes(middle), tool.word_hashes(tails[-1])]
    return np.concatenate([word[: n_head - 1], ends[0], next_word[used : n_tail - 1], ends[1]])


def compare_edited(df: DataFrame, key="doc_id", text="text", shingle=SHINGLE, fraction_bits=FRACTION_BITS) -> DataFrame:
    """Each row's fingerprint against that of its edited text and of the next row."""
    slices = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ordered_slices(df, key, text, slices)
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, contained_in_next double"
    )
    names = [f.split()[0] for f in schema.split(", ")]

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(3)))

    def run(batches):
        tool = Sketcher(shingle, fraction_bits)
        out, size, before = [], 0, None
        for where, key_value, text_value in rows_of(batches):
            word = tool.word_hashes(text_value.encode())
            now = (where, key_value, text_value, word, tool.of_words(word))
            if before is not None and before[0] == where:
                out.append(compared(tool, before, now))
                size += len(out[-1][3]) + len(out[-1][4])
                if len(out) == 500 or size >= STEP:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)
                    out, size = [], 0
            before = now
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names)

    ordered = dealt.repartitionById(slices, F.col("slice")).sortWithinPartitions(
        "slice", "tail", F.col("doc_id").asc_nulls_first(), "text"
    )
    return ordered.select("slice", "doc_id", "text").mapInArrow(run, schema)


def compared(tool: Sketcher, row, following):
    _, key, text, word, sketch = row
    _, _, next_text, next_word, next_sketch = following
    changed_sketch = tool.of_words(edited_word_hashes(tool, text, word, next_text, next_word))
    return (
        key, len(text), hashlib.sha256(edited(text, next_text).encode()).hexdigest(),
        fingerprint(sketch), fingerprint(changed_sketch),
        likeness(sketch, changed_sketch), likeness(sketch, next_sketch), containment(sketch, next_sketch),
    )
