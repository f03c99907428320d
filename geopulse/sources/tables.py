"""Reading official tables, region attributes, place dictionaries and view results."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.schemas import PLACE_VALUE, VIEW_ROW
from geopulse.sources.geojson import read_features


def read_official_csv(spark: SparkSession, path, schema=None) -> DataFrame:
    """CSV with a header; blanks in front of column names are part of the names."""
    reader = spark.read.option("header", True).option("ignoreLeadingWhiteSpace", False)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", True).csv(path)


def read_place_dict(spark: SparkSession, path, mode="FAILFAST"):
    """Place dictionary ``{name: {ste, gcc, sal}}`` as rows with the name as a column.

    Every entry ends with a closing brace, so the file is cut there and parsed entry by entry in
    parallel. ``ord`` keeps the order of the file. A bad entry ends the job; with ``mode`` PERMISSIVE the
    result is ``(rows, rejected)``, where ``rejected`` has the text of each bad entry.
    """
    chunks = (
        spark.read.option("lineSep", "}")
        .text(path)
        .select(
            "value",
            F.struct(
                F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("block"),
                F.monotonically_increasing_id().alias("row"),
            ).alias("ord"),
        )
        .where(F.contains("value", F.lit(":")))
    )
    entry = F.concat(F.lit("{"), F.regexp_replace("value", r"^\s*[,{]\s*", ""), F.lit("}}"))
    parsed = F.from_json(entry, f"MAP<STRING,{PLACE_VALUE}>", {"mode": mode})
    if mode == "PERMISSIVE":
        entries = chunks.select("ord", parsed.alias("v"), F.col("value").alias("rejected"))
        return (
            entries.where("v IS NOT NULL").select("ord", F.explode("v").alias("location", "v")).select("location", "v.*", "ord"),
            entries.where("v IS NULL").select("ord", "rejected"),
        )
    return chunks.select("ord", F.explode(parsed).alias("location", "v")).select("location", "v.*", "ord")


def read_regions(spark: SparkSession, path, code, name, state, geometry=None, format="parquet"):
    """Region attributes as ``code, name, state`` and, if named, the geometry text.

    ``geojson`` is a file or folder of feature collections: attributes are properties of the features, any
    ``geometry`` gives the JSON text of the feature's own.
    """
    if format == "geojson":
        features = read_features(spark, path)
        found = features.select(*[F.col("properties")[c].alias(n) for c, n in ((code, "code"), (name, "name"), (state, "state"))], "geometry")
        return found if geometry else found.drop("geometry")
    reader = spark.read.option("header", True) if format == "csv" else spark.read
    raw = reader.format(format).load(path)
    cols = [F.col(code).alias("code"), F.col(name).alias("name"), F.col(state).alias("state")]
    if geometry:
        cols.append(F.col(geometry).alias("geometry"))
    return raw.select(*cols)


def read_view(spark: SparkSession, path) -> DataFrame:
    """Rows ``{"key": [...], "value": {...}}`` from files that hold a JSON array, or one row, each.

    A view has one row per region, so a file is small; the files are read in parallel.
    """
    return spark.read.schema(VIEW_ROW).option("multiLine", True).json(path)


def flatten_view(df: DataFrame) -> DataFrame:
    return df.select("key", "value.*")
