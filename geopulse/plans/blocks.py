"""Texts against a model too large for every task: blocks of texts meet the part of the model that they name.

The rows are written down once with a number, which deals them to blocks of at most ``2 ** BLOCK_BITS`` bytes of text. The distinct words of each block meet
the model in one join, and what it found comes back to the block as a dictionary, which serves all its
texts in one task. So words are shuffled once for each block and not for each place where they stand, a text stays in one
piece, and a word comes at most once per block, however frequent it is: no key is hot.

Many texts are handled in up to ``SLICES`` slices of their files, one after the other. What a slice makes is written
down; then its shuffles and its part of the rows go, so that the disk holds the shuffles of one slice.
"""

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geopulse.functions.batches import reader
from geopulse.plans.skew import ROW, Dimension, stored_rows
from geopulse.session import free, scratch_of, scratch_path, shuffles_removed
from geopulse.sources.files import Folder

BLOCK, PLAIN = "_block", "_plain"
BLOCK_BITS, ROWS_BITS = 23, 12
# Bytes of files of a slice at least, and slices at most: each of them reads the model.
SLICE_BYTES, SLICES = 64 << 20, 8


def block_of(row, text) -> Column:
    """Block of a row: a run of row numbers, the shorter the larger the text is. ``2 ** s`` rows at most, of at most
    ``2 ** (BLOCK_BITS - s)`` bytes each, so that a block is bounded whatever the order of the texts."""
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    s = F.greatest(F.lit(0), F.least(F.lit(ROWS_BITS), F.lit(BLOCK_BITS) - F.ceil(F.log2(size)).cast("int")))
    run = F.call_function("shiftright", F.col(row), s)
    return F.shiftleft(run, 4).bitwiseOR(s.cast("bigint"))


def by_blocks(df: DataFrame, plain: Column, names, dimension: Dimension, key: str, work, out: str, kind: str) -> DataFrame:
    """``df`` with ``out``: what ``work(texts, found)`` makes of the texts ``plain`` of a block.

    ``names`` takes the blocks (``BLOCK``, ``PLAIN``) to the distinct ``key`` values of each; ``found`` is the Arrow table of
    the model's rows with these keys. It goes row by row and needs no key of the rows. A table that :func:`hand_over` has marked is
    removed slice by slice.
    """
    columns = df.columns + ([] if out in df.columns else [out])
    rows = stored_rows(df)
    owned = rows is not df or vars(df).get("handed", False)
    model = F.broadcast(dimension.frame) if dimension.small else dimension.frame
    kept, read = [c for c in rows.columns if c != out], reader()
    arrow = {"string": pa.string(), "bigint": pa.int64(), "double": pa.float64()}[kind]

    def meet(texts: pa.Table, part: pa.Table) -> pa.Table:
        plain = [text for chunk in texts[PLAIN].chunks for text in read(chunk)]
        made = work(plain, part)
        made = made if kind != "double" else [None if x is None else float(x) for x in made]
        return texts.select(kept).append_column(out, pa.array(made, arrow))

    def met(part: DataFrame) -> DataFrame:
        blocks = part.withColumn(PLAIN, plain).drop(out).withColumn(BLOCK, block_of(ROW, PLAIN))
        named = names(blocks.select(BLOCK, PLAIN)).select(BLOCK, key).distinct()
        found = named.withColumnRenamed(BLOCK, "_of").join(model, key)
        schema = blocks.select(*kept, F.lit(None).cast(kind).alias(out)).schema
        return blocks.groupBy(BLOCK).cogroup(found.groupBy("_of")).applyInArrow(meet, schema).select(*columns)

    place = scratch_of(rows)
    spark, folder = df.sparkSession, Folder(df.sparkSession, place)
    slices = slices_of(folder.sizes())
    if len(slices) < 2:
        return met(rows)
    path = scratch_path(spark, "rows")
    for files in slices:
        part = spark.read.schema(rows.schema).parquet(*[f"{place}/{name}" for name in files])
        done = met(part)
        with shuffles_removed(spark):
            done.write.mode("append").parquet(path)
        if owned:
            for name in files:
                folder.delete(name)
    if owned:
        free(rows)
    result = spark.read.schema(done.schema).parquet(path)
    result.scratch = path
    return result


def hand_over(table: DataFrame) -> DataFrame:
    """A table that nothing reads any more but what it is given to."""
    table.handed = True
    return table


def slices_of(sizes: dict[str, int]) -> list[list[str]]:
    """Files of at least ``SLICE_BYTES`` in each slice but for one of all; a block may lie in two, which costs its words twice."""
    n = min(SLICES, sum(sizes.values()) // SLICE_BYTES, len(sizes))
    order = sorted(sizes, key=sizes.get, reverse=True)
    return [order[i::n] for i in range(n)] if n > 1 else [order]


def with_dictionary(work, key: str, value: str):
    """Work on a dictionary as work on the Arrow table of what was found."""
    read = reader()

    def on_table(texts, part):
        keys = [k for chunk in part[key].chunks for k in read(chunk)]
        values = part[value]
        values = [v for chunk in values.chunks for v in (read(chunk) if pa.types.is_string(values.type) else chunk.to_pylist())]
        return work(texts, dict(zip(keys, values)))

    return on_table
