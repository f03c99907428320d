"""Document operations on keyed tables. Ids are unique within a table.

``version`` counts the revisions of a document. Update frames are usually far smaller than the
table; joins are left to the planner, which broadcasts the small side by its size, so the table
itself is not shuffled. Update frames may repeat an id; a stated order says which row comes last.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.constants import ID_PARTITIONS
from geopulse.session import checkpointed


def upsert(base: DataFrame, updates: DataFrame, order_col, key="_id") -> DataFrame:
    """Replace documents whose id exists, insert the others; each save is a new version.

    With several updates of one id the last by ``order_col`` stays, and all of them count as
    revisions.
    """
    fields = [c for c in base.columns if c not in (key, "version")]
    latest = updates.groupBy(key).agg(
        F.max_by(F.struct(*fields), F.col(order_col)).alias("_doc"), F.count("*").alias("_saves")
    )
    saved = F.col("_saves").isNotNull()
    stored = base.join(latest, key, "left").select(
        key,
        *[F.when(saved, F.col("_doc")[f]).otherwise(F.col(f)).alias(f) for f in fields],
        (F.col("version") + F.coalesce("_saves", F.lit(0))).alias("version"),
    )
    new = latest.join(base.select(key), key, "left_anti")
    new = new.select(key, *[F.col("_doc")[f].alias(f) for f in fields], F.col("_saves").alias("version"))
    return stored.unionByName(new)


def bulk_insert(base: DataFrame, new: DataFrame, order_col=None, key="_id", known=None, finish=None):
    """Insert documents with unknown ids as version 1. Returns ``(inserted, conflicts)``.

    A document whose id is stored already, or came earlier in the same batch (by ``order_col``, then
    by its fields), is a conflict and is not stored. Documents without an id get one.

    Only ids are grouped: how often each comes and whether it is stored is written down once. Documents
    whose id comes once and is not stored go on as they are; only copies of one id are compared by their
    fields. ``known`` may be a function from a frame of the new ids to the stored ones among them (and others),
    such as a look-up in a :class:`~geopulse.operators.keyindex.KeyIndex`, instead of all ids of ``base``.

    ``finish`` makes the stored documents of some of ``new``, row by row and without losing one, from their fields alone: it
    is not run for documents that are stored already, and once for equal copies. The order by fields is that of the finished ones.
    """
    new = with_generated_ids(new, key)
    fields = [c for c in new.columns if c not in (key, "version")]
    copies = new.groupBy(key).agg(F.count("*").alias("_copies"))
    if known is not None:
        copies = checkpointed(copies)
    stored = (base if known is None else known(copies)).select(key).withColumn("_stored", F.lit(True))
    ids = copies.join(stored, key, "left").withColumn("_stored", F.col("_stored").isNotNull())
    # Usually few of the batch: the others need no join but with these.
    odd = checkpointed(ids.where("_stored OR _copies > 1"))
    once = new.join(odd.select(key), key, "left_anti").select(key, *fields)
    repeated = new.join(odd.where("NOT _stored").select(key), key, "left_semi")
    if finish is not None:
        once, repeated = finish(once), finish(repeated.select(key, *fields).dropDuplicates())
        fields = [c for c in once.columns if c not in (key, "version")]
    order = F.struct(*([order_col] if order_col else []), *fields)
    first = repeated.groupBy(key).agg(F.min_by(F.struct(*fields), order).alias("_doc")).select(key, "_doc.*")
    inserted = once.unionByName(first).withColumn("version", F.lit(1).cast("bigint"))
    rejected = F.when(F.col("_stored"), F.col("_copies")).otherwise(F.col("_copies") - 1)
    return inserted, odd.select(key, rejected.alias("rejected"))


def with_generated_ids(new: DataFrame, key="_id") -> DataFrame:
    """Random ids where missing, written down once: a task that runs again must not mint others."""
    return checkpointed(new.withColumn(key, F.coalesce(F.col(key), F.uuid())))


def get_documents(df: DataFrame, ids: DataFrame, key="_id") -> DataFrame:
    return df.join(ids.select(key), key, "left_semi")


def delete_documents(df: DataFrame, ids: DataFrame, key="_id"):
    """Returns ``(remaining, missing ids)``."""
    wanted = ids.select(key)
    return df.join(wanted, key, "left_anti"), wanted.distinct().join(df.select(key), key, "left_anti")


def patch(base: DataFrame, patches: DataFrame, order_col, key="_id", given="fields"):
    """Overwrite the fields each patch row names in its array ``given``, also with NULL.

    Of several patches of one field the last by ``order_col`` counts; each patch is a revision.
    Returns ``(patched table, ids that do not exist)``; missing ids are not inserted.
    """
    changes = [c for c in patches.columns if c not in (key, given, order_col) and c in base.columns]

    def last(c):
        # Rows that do not name the field have no place in its order.
        at = F.when(F.array_contains(given, c), F.struct(order_col))
        return F.max_by(F.struct(F.col(c).alias("value")), at).alias(f"_new_{c}")

    reduced = patches.groupBy(key).agg(F.count("*").alias("_saves"), *[last(c) for c in changes])
    joined = base.join(reduced, key, "left")

    def value(c):
        if c == "version":
            return (F.col(c) + F.coalesce("_saves", F.lit(0))).alias(c)
        if c not in changes:
            return F.col(c)
        new = F.col(f"_new_{c}")
        return F.when(new.isNotNull(), new["value"]).otherwise(F.col(c)).alias(c)

    missing = patches.select(key).distinct().join(base.select(key), key, "left_anti")
    return joined.select(*[value(c) for c in base.columns]), missing


def last_documents(df: DataFrame, n=1, by="tid") -> DataFrame:
    return df.orderBy(F.desc(by)).limit(n)


def high_water_mark(df: DataFrame, by="tid", server="server") -> DataFrame:
    """Greatest id per server: where the next harvest goes on."""
    return df.groupBy(server).agg(F.max(by).alias(by))


def id_partition(col, n=ID_PARTITIONS):
    """Stable bucket of an id, from the first 32 bits of its MD5."""
    tid = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.conv(F.substring(F.md5(tid), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def with_doc_id(df: DataFrame, n=ID_PARTITIONS, tid="tid") -> DataFrame:
    """Document id ``partition:tid``."""
    return df.withColumn("_id", F.concat_ws(":", id_partition(tid, n).cast("string"), F.col(tid)))
