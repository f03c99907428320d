"""Writing results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.constants import BATCH_SIZE

# Documents per file: large files, as small ones would swamp a large store.
FILE_ROWS = 1_000_000


def save_gazetteer(df: DataFrame, path):
    df.write.mode("overwrite").parquet(path)


def load_gazetteer(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def upload_batched(df: DataFrame, send, n=BATCH_SIZE):
    """Hand documents to ``send(list of dicts)`` in batches of ``n``, and the rest of each task.

    Runs inside the tasks. A task that runs again sends its batches again, so ``send`` should
    ignore ids it has stored before.
    """

    def upload(rows):
        batch = []
        for row in rows:
            batch.append(row.asDict(recursive=True))
            if len(batch) == n:
                send(batch)
                batch = []
        if batch:
            send(batch)

    df.foreachPartition(upload)


def write_batched(df: DataFrame, path, n=FILE_ROWS, partition_by=(), mode="append"):
    """Files of at most ``n`` documents."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", n)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_json(df: DataFrame, path, compression=None, mode="overwrite"):
    """JSON lines, optionally gzip."""
    writer = df.write.mode(mode).option("ignoreNullFields", False)
    if compression:
        writer = writer.option("compression", compression)
    writer.json(path)


def to_documents(df: DataFrame, out="document") -> DataFrame:
    """Each row as one JSON text, NULL fields included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(out))


def framed(df: DataFrame, col, opening, between, closing) -> DataFrame:
    """Text lines with marks around and between them, per task and as the rows stream through.

    Each file written from the result stands on its own, e.g. as one JSON array.
    """

    def frame(batches):
        import pandas as pd

        started = False
        for batch in batches:
            lines = batch[col].tolist()
            if lines:
                marks = [between if started else opening] + [between] * (len(lines) - 1)
                started = True
                yield pd.DataFrame({"value": [mark + line for mark, line in zip(marks, lines)]})
        if started:
            yield pd.DataFrame({"value": [closing]})

    return df.select(col).mapInPandas(frame, "value string")


def write_json_array(df: DataFrame, path, mode="overwrite"):
    """One JSON array per file."""
    framed(to_documents(df), "document", "[", ",", "]").write.mode(mode).text(path)


def materialise(df: DataFrame, path, force=False) -> DataFrame:
    """A named result: computed when absent or forced, read otherwise."""
    df.write.mode("overwrite" if force else "ignore").parquet(path)
    return df.sparkSession.read.parquet(path)
