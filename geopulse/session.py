"""Session settings and lineage cuts."""

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Spark's setting that shuffle files go with the query that wrote them.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(app_name="geopulse", master=None, shuffle_partitions=None, **conf):
    """A session with the settings the jobs rely on (UTC, adaptive plans, skew splitting)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it, as an installed
    package would be."""
    environment = spark.sparkContext.environment
    path = environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join([p for p in (path, ROOT) if p])


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, named by spark.checkpoint.dir.

    Where the setting is absent a temporary folder is made, but only in local mode: on a
    cluster a machine-local folder would lose data with its machine.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current is None:
        if configured is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
            configured = tempfile.mkdtemp(prefix="geopulse-")
            # The folder is this process's own; a configured one is left to who configured it.
            atexit.register(shutil.rmtree, configured, ignore_errors=True)
        context.setCheckpointDir(configured)
        current = context.getCheckpointDir()
    return configured or current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Compute once and cut the lineage, in storage that outlives an executor. The shuffles that made it are gone."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        # A frame of its own, whose query is made here.
        return df.select("*").checkpoint()


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Queries that run inside leave no shuffle files: they go when a query ends, and not when the driver happens to
    collect its garbage, until when those of all steps before lie on the disk."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, compressed, read by column, kept when executors
    are lost, and of a size that later plans know. The shuffles that made it are gone. See :func:`free`."""
    path = scratch_path(df.sparkSession, name)
    with shuffles_removed(df.sparkSession):
        df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def scratch_of(table: DataFrame):
    """The folder of a table made by :func:`written`; None of other frames, also of those with such a column."""
    return vars(table).get("scratch")


def free(*tables: DataFrame) -> None:
    """Remove tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        path = scratch_of(table)
        if path is not None:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
