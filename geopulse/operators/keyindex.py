"""Which files of a store may hold a key: for each file its range of keys and a Bloom filter of them.

A store is a folder of Parquet files below one partition column, the bucket. The index lies in the store's
folder ``_keys``, which readers of the store skip, and has a row for each file: bucket, file, first and last key, how many,
and a filter of some ``BITS_PER_KEY`` bits a key as an array of 64-bit words.

A batch of new keys meets it in three steps. Files whose range has no key of the batch are not
read; of a batch of up to ``PROBED`` keys each key is also tried in the filters. From files that are left only the
key column is read, and a filter of the batch itself, at most ``BATCH_WORDS`` words, lets through stored keys
that may be in the batch. What is left is exact work for a join, in size like the batch and not like the store.
A file that the index does not know yet is always read, so a job that ended between writing files and
indexing them leaves nothing undone but time.
"""

import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.sources.files import Folder

BITS_PER_KEY = 10
PROBED = 10_000
BATCH_WORDS = 1 << 17
# Local paths are written with one slash or three.
LOCAL = "^file:/+"


def words_for(rows) -> Column:
    """Words of a filter for so many keys: a power of two."""
    return F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.ceil(F.log2(rows * (BITS_PER_KEY / 64.0))))).cast("bigint")


def hashes(key) -> list[Column]:
    return [F.xxhash64(F.col(key)), F.xxhash64(F.col(key), F.lit(1))]


def place(hashed: Column, words) -> Column:
    """The bit of a hash in a filter of so many words."""
    return F.pmod(hashed, words * F.lit(64).cast("bigint"))


def is_set(filter_words: Column, hashed: Column) -> Column:
    at = place(hashed, F.size(filter_words).cast("bigint"))
    return F.getbit(F.get(filter_words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1


def filters(keys: DataFrame, by, key) -> DataFrame:
    """``by, filter`` from rows ``by, key, words``; all rows of a group have the same number of words."""
    at = F.explode(F.array(*[place(h, F.col("words")) for h in hashes(key)])).alias("at")
    set_bits = keys.select(*by, at).select(
        *by, F.shiftright("at", 6).alias("word"), F.expr("shiftleft(CAST(1 AS BIGINT), CAST(at & 63 AS INT))").alias("bits")
    )
    # A zero for every word, so that the array has them all.
    sizes = keys.groupBy(*by).agg(F.max("words").alias("words"))
    zeros = sizes.select(*by, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("words") - 1)).alias("word"), F.lit(0).cast("bigint").alias("bits"))
    words = set_bits.unionByName(zeros).groupBy(*by, "word").agg(F.bit_or("bits").alias("bits"))
    return words.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("word", "bits")))["bits"].alias("filter"))


class KeyIndex:
    """The index of one store. A key is unique within its bucket."""

    def __init__(self, spark: SparkSession, store: str, key="_id", bucket="partition", kinds="_id STRING, partition INT", probed=PROBED):
        """``kinds`` are the types of key and bucket as DDL."""
        self.spark, self.store, self.key, self.bucket, self.kinds, self.probed = spark, store, key, bucket, kinds, probed
        self.path = f"{store}/_keys"
        fields = dict(f.split() for f in kinds.split(", "))
        self._schema = (
            f"bucket {fields[bucket]}, file STRING, first {fields[key]}, last {fields[key]}, keys BIGINT, filter ARRAY<BIGINT>"
        )

    def files(self) -> list[str]:
        """The store's files now, from a listing; names are those of URIs."""
        return sorted(re.sub(LOCAL, "file:///", f) for f in self.spark.read.schema(self.kinds).parquet(self.store).inputFiles())

    def entries(self) -> DataFrame:
        if not Folder(self.spark, self.path).names():
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(self.path)

    def rows(self, files) -> DataFrame:
        """Key and bucket of all rows of some files."""
        if not files:
            return self.spark.createDataFrame([], self.kinds)
        return self.spark.read.schema(self.kinds).option("basePath", self.store).parquet(*map(unquote, files))

    def _unknown(self, files) -> list[str]:
        # One name for each file of the store.
        known = {r.file for r in self.entries().select("file").collect()}
        return [f for f in files if f not in known]

    def update(self) -> int:
        """Index the files that have come since; returns how many."""
        new = self._unknown(self.files())
        if not new:
            return 0
        rows = self.rows(new).select(F.col(self.bucket).alias("bucket"), F.col(self.key).alias("key"), F.regexp_replace("_metadata.file_path", LOCAL, "file:///").alias("file"))
        sizes = rows.groupBy("bucket", "file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("keys"))
        sizes = sizes.withColumn("words", words_for(F.col("keys")))
        keyed = rows.join(sizes.select("file", "words"), "file")
        entries = sizes.drop("words").join(filters(keyed, ["file"], "key"), "file")
        entries.select("bucket", "file", "first", "last", "keys", "filter").write.mode("append").parquet(self.path)
        return len(new)

    def candidates(self, ids: DataFrame, n=None) -> list[str]:
        """Files that may hold one of the keys: all that do, and a few more. ``n`` is how many keys there are, if known."""
        files = self.files()
        wanted = ids.select(F.col(self.bucket).alias("bucket"), F.col(self.key).alias("key"))
        n = wanted.count() if n is None else n
        span = [F.min("key").alias("low"), F.max("key").alias("high")]
        near = (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))
        if n <= self.probed:
            each = F.struct("key", *[h.alias(f"h{i}") for i, h in enumerate(hashes("key"))])
            span.append(F.collect_list(each).alias("wanted"))

            def held(k):
                return k["key"].between(F.col("first"), F.col("last")) & is_set(F.col("filter"), k["h0"]) & is_set(F.col("filter"), k["h1"])

            near = near & F.exists("wanted", held)
        # A row for each bucket of the batch.
        spans = wanted.groupBy("bucket").agg(*span)
        hit = {r.file for r in self.entries().join(spans, "bucket").where(near).select("file").collect()}
        unknown = set(self._unknown(files))
        return [f for f in files if f in hit or f in unknown]

    def known(self, ids: DataFrame) -> DataFrame:
        """Stored keys that may be among ``ids``: bucket and key, all that are and a few more."""
        n = ids.count()
        files = self.candidates(ids, n) if n else []
        stored = self.rows(files)
        if not files:
            return stored
        words = F.least(F.lit(BATCH_WORDS), words_for(F.lit(n)))
        batch = filters(ids.select(F.lit(1).alias("all"), F.col(self.key).alias("key"), words.alias("words")), ["all"], "key")
        bits = batch.select("filter").scalar()
        return stored.where(is_set(bits, hashes(self.key)[0]) & is_set(bits, hashes(self.key)[1]))

    # --- pages and marks ------------------------------------------------------------------------

    def ranges(self) -> list:
        """``bucket, file, first, last, keys`` of the files that are there and indexed: one row for each file."""
        there = set(self.files())
        rows = self.entries().select("bucket", "file", "first", "last", "keys").collect()
        return [r for r in rows if r.file in there]

    def whole_rows(self, files) -> DataFrame:
        """All columns of some files."""
        schema = self.spark.read.parquet(self.store).schema
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.store).parquet(*map(unquote, files))

    def marks(self) -> DataFrame:
        """``bucket, mark``: the greatest key of every bucket. Indexed files are not opened."""
        found = {}
        for r in self.ranges():
            found[r.bucket] = max(r.last, found.get(r.bucket, r.last))
        kinds = dict(f.split() for f in self.kinds.split(", "))
        schema = f"bucket {kinds[self.bucket]}, mark {kinds[self.key]}"
        known = self.spark.createDataFrame(list(found.items()), schema)
        late = self.rows(self._unknown(self.files())).groupBy(F.col(self.bucket).alias("bucket")).agg(F.max(self.key).alias("mark"))
        return known.unionByName(late).groupBy("bucket").agg(F.max("mark").alias("mark"))

    def page_files(self, cursor, n: int, newest=False) -> list[str]:
        """Files that may hold one of the ``n`` keys next above the cursor; with ``newest`` those next below it.

        Files that lie beyond the cursor as a whole are taken in order until they have ``n`` keys; no file that
        begins after the last of these is needed. Without a cursor a page begins at the end.
        """
        ranges = [r for r in self.ranges() if cursor is None or (r.first < cursor if newest else r.last > cursor)]
        near, far = ("last", "first") if newest else ("first", "last")
        order = sorted(ranges, key=lambda r: r[far], reverse=newest)
        seen, end = 0, None
        for r in order:
            if cursor is None or (r[near] < cursor if newest else r[near] > cursor):
                seen += r["keys"]
                if seen >= n:
                    end = r[far]
                    break
        if end is not None:
            ranges = [r for r in ranges if (r[near] >= end if newest else r[near] <= end)]
        return sorted({r.file for r in ranges} | set(self._unknown(self.files())))

    def page_after(self, cursor, n: int) -> DataFrame:
        """Up to ``n`` rows above the cursor, nearest first."""
        rows = self.whole_rows(self.page_files(cursor, n))
        return (rows if cursor is None else rows.where(F.col(self.key) > cursor)).orderBy(self.key).limit(n)

    def page_before(self, cursor, n: int) -> DataFrame:
        """Up to ``n`` rows below the cursor, newest first; without a cursor the newest of all."""
        rows = self.whole_rows(self.page_files(cursor, n, newest=True))
        return (rows if cursor is None else rows.where(F.col(self.key) < cursor)).orderBy(F.desc(self.key)).limit(n)
