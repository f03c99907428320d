"""Reading post dumps."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geopulse.functions.lookup import computed_once, let
from geopulse.schemas import POST_LINE, POST_OBJECT

# First match per line; fixed patterns: what stands ahead of the value, and the value. Escapes are not decoded and
# end at the first quote.
NUMBER, SHORTEST = r"\p{Nd}+", r"""[^"\n\r\u0085\u2028-\u2029]*"""
FIELD_PATTERNS = {
    "tid": ('"id":"', NUMBER),
    "author": ('"author_id":"', NUMBER),
    "date": ('"created_at":"', SHORTEST),
    "location": ('"full_name":"', SHORTEST),
    "text": ('"text":"', SHORTEST),
    "tags": ('"tags":"', SHORTEST),
}


def read_post_lines(spark: SparkSession, path) -> DataFrame:
    """One row per line. The text source splits large files at line ends."""
    return spark.read.text(path)


def extract_fields(lines: DataFrame, mode="regex") -> DataFrame:
    """Post fields of each line; lines without an id (header, footer) are left out.

    ``regex`` takes the first raw match per line. ``json`` parses the line and decodes escapes.
    """
    line = F.col("value")
    if mode == "regex":
        def found(name):
            # The line is searched once; an empty value is told from a miss by the whole match.
            ahead, pattern = FIELD_PATTERNS[name]
            value = let(
                F.regexp_extract(line, f'{ahead}{pattern}"', 0),
                lambda match: F.when(match != "", F.substring(match, F.lit(len(ahead) + 1), F.length(match) - len(ahead) - 1)),
            )
            return value.alias(name)

        # Filters of the fields stay above, so no field is searched again for them.
        return computed_once(lines, *[found(name) for name in FIELD_PATTERNS]).where("tid IS NOT NULL")
    body = F.regexp_replace(line, r",\s*$", "")
    doc = lines.select(F.from_json(body, POST_LINE).alias("d")).where("d.id IS NOT NULL")
    return doc.select(
        F.col("d.id").alias("tid"),
        F.col("d.doc.data.author_id").alias("author"),
        F.col("d.doc.data.created_at").alias("date"),
        F.get(F.col("d.doc.includes.places"), F.lit(0))["full_name"].alias("location"),
        F.col("d.doc.data.text").alias("text"),
        F.col("d.value.tags").alias("tags"),
        F.col("d.value.tokens").alias("tokens"),
    )


def read_post_array(spark: SparkSession, path, mode="FAILFAST"):
    """Posts of a pretty-printed JSON array whose objects begin with ``_id``.

    The reader cuts the file at each ``"_id"``, so one large file is split among tasks and every object is
    still parsed whole. Inside a JSON string the quotes of such a text have a backslash before them.

    A bad object ends the job; with ``mode`` PERMISSIVE the result is ``(posts, rejected)``, where
    ``rejected`` has the text of each bad object. A file with text but without any object is an error.
    """
    marker = '"_id"'
    chunks = spark.read.option("lineSep", marker).text(path)
    # What stands ahead of the first marker holds no object.
    objects = chunks.where(F.regexp_like("value", F.lit(r"^\s*:")))
    if objects.isEmpty() and not chunks.where(F.regexp_like("value", F.lit(r"[^\s\[\]]"))).isEmpty():
        raise ValueError(f"no object that begins with {marker} in {path}")
    body = F.regexp_replace("value", r"\s*(?:,\s*\{|\])\s*$", "")
    parsed = F.from_json(F.concat(F.lit("{" + marker), body), POST_OBJECT, {"mode": mode}).alias("d")
    if mode != "PERMISSIVE":
        return objects.select(parsed).select("d.*")
    rows = objects.select(parsed, F.col("value").alias("rejected"))
    # A bad object parses to nothing but NULL fields.
    bad = F.col("d").isNull() | F.col("d._id").isNull()
    return rows.where(~bad).select("d.*"), rows.where(bad).select("rejected")
