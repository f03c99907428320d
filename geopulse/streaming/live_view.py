"""Views that stay current while documents arrive.

The running statistics are a stateful aggregate: a batch gives the regions it changed, with their new values
(update mode). The served view is kept in buckets of its key. A batch rewrites the buckets of the regions it
changed and leaves all others as they are; then one small commit file says of every bucket which batch wrote it
last. A reader goes by the newest commit, so it never sees half a batch, and a batch that runs again writes the
same folder and the same commit.
"""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.constants import TOPICS
from geopulse.functions.scalars import mentions
from geopulse.operators.views import reduce_with
from geopulse.sources.files import Folder

BUCKETS = 64
BUCKET = "_bucket"


def live_view(posts: DataFrame, topic, by="sal", text="content", value="score", words=None) -> DataFrame:
    """Running statistics per region; the state is one row per region, not per post."""
    topic_words = TOPICS[topic] if words is None else words
    return posts.where(mentions(text, topic_words)).groupBy(by).agg(*reduce_with("stats", value))


class ViewStore:
    """A keyed table in buckets, changed batch by batch.

    ``path/batch=N/_bucket=K`` has bucket K as batch N left it, ``path/commits/N.json`` names the newest batch of
    every bucket after batch N, and the columns.
    """

    def __init__(self, spark: SparkSession, path: str, keys, buckets=BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets
        self._folder = Folder(spark, path)

    # --- commits ---------------------------------------------------------------------------------

    def commits(self) -> list[int]:
        names = [n for n in self._folder.names("commits") if n.endswith(".json") and n[0].isdigit()]
        return sorted(int(n[: -len(".json")]) for n in names)

    def commit_at(self, batch: int) -> dict:
        commit = json.loads(self._folder.read(f"commits/{batch}.json"))
        commit["buckets"] = {int(k): v for k, v in commit["buckets"].items()}
        return commit

    def newest(self, before=None) -> dict:
        """The newest commit, or the newest of a batch before a number."""
        known = [n for n in self.commits() if before is None or n < before]
        return self.commit_at(known[-1]) if known else {"batch": None, "schema": None, "of": self.buckets, "buckets": {}}

    def _commit(self, batch: int, schema: str, of: int, buckets: dict):
        self._folder.write(f"commits/{batch}.json", json.dumps({"batch": batch, "schema": schema, "of": of, "buckets": buckets}))

    # --- rows ------------------------------------------------------------------------------------

    def _rows(self, commit: dict, buckets=None) -> DataFrame:
        wanted = {k: n for k, n in commit["buckets"].items() if buckets is None or k in buckets}
        if not wanted:
            return self.spark.createDataFrame([], commit["schema"])
        folders = [f"{self.path}/batch={n}/{BUCKET}={k}" for k, n in sorted(wanted.items())]
        return self.spark.read.schema(commit["schema"]).parquet(*folders)

    def read(self) -> DataFrame:
        """The table as the newest commit has it."""
        commit = self.newest()
        if commit["schema"] is None:
            raise FileNotFoundError(f"no batch was stored in {self.path} yet")
        return self._rows(commit)

    def merge(self, changes: DataFrame, batch: int):
        """Rows of ``changes`` replace those of equal keys; other rows of their buckets are written again."""
        before = self.newest(batch)
        # A table stays in the buckets it began with.
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(before["of"])).cast("int")
        changes = changes.withColumn(BUCKET, bucket).persist()
        try:
            # One row for each bucket at most.
            touched = {r[0] for r in changes.select(BUCKET).distinct().collect()}
            rows = changes
            if touched & set(before["buckets"]):
                old = self._rows(before, touched).withColumn(BUCKET, bucket)
                same = [old[k].eqNullSafe(changes[k]) for k in (BUCKET, *self.keys)]
                rows = changes.unionByName(old.join(changes, same, "left_anti"))
            if touched:
                # A bucket is one file: it is small, and a reader opens one for each bucket.
                rows = rows.repartition(len(touched), BUCKET)
                rows.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/batch={batch}")
            schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in changes.schema if f.name != BUCKET)
            self._commit(batch, schema, before["of"], before["buckets"] | dict.fromkeys(sorted(touched), batch))
        finally:
            changes.unpersist()

    def clean(self, keep=2):
        """Remove commits but the last ``keep``, for readers that have begun, and what only the others name."""
        known = self.commits()
        stay = known[-keep:]
        used = {(n, k) for c in stay for k, n in self.commit_at(c)["buckets"].items()}
        for c in known[:-keep]:
            self._folder.delete(f"commits/{c}.json")
        for name in self._folder.names():
            n = int(name[len("batch="):]) if name.startswith("batch=") else None
            if n is None or n > stay[-1]:
                continue
            if n not in {batch for batch, _ in used}:
                self._folder.delete(name)
                continue
            for bucket in self._folder.names(name):
                if bucket.startswith(f"{BUCKET}=") and (n, int(bucket[len(BUCKET) + 1 :])) not in used:
                    self._folder.delete(f"{name}/{bucket}")


def run_live_view(view: DataFrame, path, checkpoint, trigger=None, keep=2, keys=("sal",), buckets=BUCKETS):
    """Keep the view in a :class:`ViewStore`; the default trigger takes what is there and stops."""

    def merge(batch: DataFrame, batch_id: int):
        store = ViewStore(batch.sparkSession, path, keys, buckets)
        store.merge(batch, batch_id)
        store.clean(keep)

    return (
        view.writeStream.outputMode("update")
        .foreachBatch(merge)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_live_view(spark: SparkSession, path) -> DataFrame:
    return ViewStore(spark, path, []).read()
