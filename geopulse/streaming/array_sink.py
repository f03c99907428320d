"""A stream as files that each hold a whole JSON array.

An open array is no JSON until its end is written, and a file cannot be opened again on every file system. So a
batch closes what it opens: its rows are written as arrays in a folder of their own, get their names when
they are whole, and are named in a commit. A batch that runs again, after its commit or before it, leaves
the same files; what a batch without a commit left is no part of the result.
"""

import json

from pyspark.sql import DataFrame, SparkSession

from geopulse.sources.files import Folder
from geopulse.sources.sinks import write_json_array


class JsonArrays:
    """``path/array-N-K.json`` is array K of batch N, ``path/_commits/N.json`` names the arrays of batch N."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._folder = spark, path, Folder(spark, path)

    def committed(self) -> list[int]:
        return sorted(int(n[: -len(".json")]) for n in self._folder.names("_commits") if n.endswith(".json") and n[0].isdigit())

    def files(self) -> list[str]:
        """All arrays of batches that are complete, batch by batch."""
        return [f"{self.path}/{f}" for n in self.committed() for f in json.loads(self._folder.read(f"_commits/{n}.json"))]

    def append(self, rows: DataFrame, batch: int):
        if batch in self.committed():
            return
        for name in self._folder.names():
            if name.startswith(f"array-{batch}-"):
                self._folder.delete(name)
        draft = f"_drafts/{batch}"
        write_json_array(rows, f"{self.path}/{draft}")
        parts = [n for n in self._folder.names(draft) if n.startswith("part-")]
        named = {part: f"array-{batch}-{k}.json" for k, part in enumerate(parts)}
        for part, name in named.items():
            self._folder.move(f"{draft}/{part}", name)
        self._folder.write(f"_commits/{batch}.json", json.dumps(list(named.values())))
        self._folder.delete(draft)

    def read(self, schema: str) -> DataFrame:
        """The rows of all complete batches; each file is parsed as a whole by one task."""
        files = self.files()
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("multiLine", True).json(files)


def array_stream(df: DataFrame, path, checkpoint, trigger=None):
    """Append arriving rows as JSON arrays, one for each task of a batch that has rows."""

    def append(batch: DataFrame, batch_id: int):
        JsonArrays(batch.sparkSession, path).append(batch, batch_id)

    return (
        df.writeStream.foreachBatch(append)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
