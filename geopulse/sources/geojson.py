"""Reading GeoJSON feature collections of any size, many tasks to a file.

The text source cuts a file after every closing brace, wherever a task begins to read. A piece by itself does not
say whether it stands in a string, nor how deep; both are sums over what lies before it: the number of quotes
tells strings, and braces outside of strings tell the depth. They are added up inside a block of the file, and
over blocks by one row for each. A feature is what ends with a brace that leads back to the depth of the collection, however
deep its geometry nests. Its pieces are put together and parsed as one JSON text.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geopulse.session import checkpointed

# Depth of braces inside a member of the collection.
LEVEL = 2
FEATURE = "type STRING, id STRING, properties MAP<STRING,STRING>, geometry STRING"
# What may stand ahead of the brace that opens an object: text without braces, and strings.
AHEAD = r'(?:[^{"]++|"(?:[^"\\]++|\\.)*+")*+'


def _braces(parts, odd) -> F.Column:
    """Opening braces in every other part of a text cut at its quotes."""
    side = F.array_join(F.filter(parts, lambda _, i: i % 2 == (1 if odd else 0)), "")
    return F.length(side) - F.length(F.replace(side, F.lit("{"), F.lit("")))


def pieces(spark: SparkSession, path) -> DataFrame:
    """The text between closing braces: where it stands, whether its quotes are odd, and its opening
    braces outside of strings, should it begin outside or inside of one."""
    text = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        "value",
    )
    # A backslash and what follows it says nothing of strings. No escape ends with a brace, so none is cut.
    parts = F.split(F.regexp_replace("value", r"\\.", ""), '"', -1)
    return checkpointed(
        text.select(
            "*", ((F.size(parts) - 1) % 2).alias("odd"), _braces(parts, False).alias("outside"), _braces(parts, True).alias("inside")
        )
    )


def _carried(df: DataFrame, value, start, fold, name) -> DataFrame:
    """Adds ``name``: ``fold`` of ``value`` over all earlier rows of the file, ``start`` for none.

    Rows of a block are one window's work, a file has one row for each block.
    """
    earlier = (Window.unboundedPreceding, -1)
    in_block = Window.partitionBy("file", "block").orderBy("row").rowsBetween(*earlier)
    over_blocks = Window.partitionBy("file").orderBy("block").rowsBetween(*earlier)
    blocks = df.groupBy("file", "block").agg(fold(value).alias("_of")).select("file", "block", fold("_of").over(over_blocks).alias("_before"))
    out = df.join(blocks, ["file", "block"]).withColumn("_in", fold(value).over(in_block))
    if start is None:
        return out.withColumn(name, F.coalesce("_in", "_before")).drop("_in", "_before")
    return out.withColumn(name, F.coalesce("_in", start) + F.coalesce("_before", start)).drop("_in", "_before")


def cut_features(spark: SparkSession, path) -> DataFrame:
    """``file, text`` of every object that is a member of a collection: its features, and others such as ``crs``."""
    rows = _carried(pieces(spark, path), "odd", F.lit(0), F.sum, "quotes")
    begins, ends = F.col("quotes") % 2, (F.col("quotes") + F.col("odd")) % 2
    opened = F.when(begins == 0, F.col("outside")).otherwise(F.col("inside"))
    # The brace that ends the piece counts outside of strings only.
    closed = F.when(ends == 0, 1).otherwise(0)
    rows = rows.withColumn("closed", closed).withColumn("change", opened - closed).drop("odd", "outside", "inside", "quotes")
    rows = _carried(rows, "change", F.lit(0), F.sum, "depth")
    is_end = (F.col("closed") == 1) & (F.col("depth") + F.col("change") == LEVEL - 1)
    rows = rows.withColumn("end", F.when(is_end, F.struct("block", "row")))
    # The last end before a piece names the feature it is part of.
    rows = _carried(rows, "end", None, F.max, "after")
    part = F.struct("block", "row", "value", "depth", F.col("end").isNotNull().alias("last"))
    found = rows.groupBy("file", "after").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    found = found.where(F.element_at("parts", -1)["last"])
    text = F.concat(F.array_join("parts.value", "}"), F.lit("}"))
    top = F.regexp_replace(text, rf"^{AHEAD}\{{{AHEAD}", "")
    return found.select("file", F.when(F.col("parts")[0]["depth"] == 0, top).otherwise(F.regexp_replace(text, f"^{AHEAD}", "")).alias("text"))


def read_features(spark: SparkSession, path, mode="FAILFAST"):
    """``type, id, properties, geometry`` of the features; properties are a map of text, the geometry is its JSON.

    A bad feature ends the job; with ``mode`` PERMISSIVE the result is ``(features, rejected)``, where ``rejected``
    has the text of each bad one. Members of a collection that are no features are left out.
    """
    rows = cut_features(spark, path).select("text", F.from_json("text", FEATURE, {"mode": mode}).alias("f"))
    features = rows.where(F.col("f.type") == "Feature").select("f.*")
    if mode != "PERMISSIVE":
        return features
    parsed = checkpointed(rows)
    # A text that is no JSON parses to nothing but NULL fields.
    nothing = F.coalesce("f.type", "f.id", "f.geometry", F.to_json("f.properties")).isNull()
    return parsed.where(F.col("f.type") == "Feature").select("f.*"), parsed.where(nothing).select(F.col("text").alias("rejected"))
