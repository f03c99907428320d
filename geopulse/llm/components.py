"""Connected components of a link table, in Spark.

Large-star and small-star steps alternate until nothing changes: a node links its neighbours to the
least one it knows. The number of rounds follows the logarithm of the longest chain. Every step is an
aggregate with a partial result for each task and an equi-join whose hot keys can be split; each round is
written to the shared folder.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geopulse.llm.common import free, written


def linked_to_least(pairs: DataFrame) -> DataFrame:
    """For ``node, near``: near with the least of the node and what is near to it (``least``)."""
    least = pairs.groupBy("node").agg(F.min("near").alias("least"))
    least = least.withColumn("least", F.least("node", "least"))
    return pairs.join(least, "node")


def large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    got = linked_to_least(both.toDF("node", "near"))
    return got.where("near > node").select(F.col("near").alias("a"), F.col("least").alias("b"))


def small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
    got = linked_to_least(down)
    moved = got.select(F.col("near").alias("a"), F.col("least").alias("b"))
    return moved.unionByName(got.select(F.col("node").alias("a"), F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, root``: each linked node that is not the least of its component, and that least.

    ``links`` has columns ``a, b`` of one integer type; self-links and repeats do no harm.
    """
    links = written(links.where("a <> b").distinct(), "links")
    before = None
    while True:
        # A task's result is a few numbers: how many links, and a sum over their hashes.
        mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        now = tuple(links.agg(F.count(F.lit(1)), mark).first())
        if now == before or not now[0]:
            roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots.scratch = links.scratch
            return roots
        before = now
        stars = written(small_star(large_star(links)).where("a <> b").distinct(), "links")
        free(links)
        links = stars
