"""End-to-end jobs composed of the operators."""

from dataclasses import dataclass, field
from functools import reduce
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from geopulse.constants import (
    INCOME_FENCED,
    INCOME_METRICS,
    OFFENCES,
    SCORE_LABELS,
    STATE_OF_INTEREST,
    TOPICS,
    TOTAL_OFFENCES,
)
from geopulse.functions.lookup import MAX_LOOKUP_ROWS, computed_once
from geopulse.functions.scalars import score_bin, topic_flags
from geopulse.functions.text import SPACE, normalise_location, strip_social
from geopulse.operators.docstore import bulk_insert, id_partition
from geopulse.operators.filters import (
    drop_all_null,
    drop_any_null,
    fill_zero,
    geo_only as keep_geo,
    in_state,
    require,
    row_sum,
    valid_id,
)
from geopulse.operators.keyindex import KeyIndex
from geopulse.operators.gazetteer import PlaceResolver, build_gazetteer
from geopulse.operators.language import LanguageDetector
from geopulse.operators.official import correlations, count_bands, describe5, drop_outliers, extremes
from geopulse.operators.regions import join_regions, metric_layers, region_metrics
from geopulse.operators.sentiment import Normaliser, Scorer
from geopulse.operators.views import topic_views
from geopulse.plans.blocks import hand_over
from geopulse.plans.skew import ROW, stored_rows, with_row_id
from geopulse.schemas import POST_COLUMNS
from geopulse.sources.posts import extract_fields, read_post_lines
from geopulse.sources.sinks import save_gazetteer, write_batched
from geopulse.session import checkpointed, free
from geopulse.sources.tables import read_place_dict

# A step takes posts, the text column, the row key and the output column, and adds that column.
Step = Callable[[DataFrame, str, list, str], DataFrame]


@dataclass
class Enrichers:
    """The three exchangeable steps of an ingest: normaliser, language detector, scorer.

    ``keeps_text`` says that the normaliser never empties a text that is not blank. The job then
    leaves out its test for empty content, which would run the normaliser a second time, as
    filters are moved below the columns they look at. ``joins`` says that a step joins its model:
    the posts are then written down with a number for each before every step. A step may remove the table that it
    gets, if its result does not read it.
    """

    normaliser: Step
    detector: Step
    scorer: Step
    resolver: PlaceResolver = field(default=None)
    keeps_text: bool = False
    joins: bool = False

    @classmethod
    def from_tables(
        cls, lemmas, lexicon, profiles=None, gazetteer=None, rules=False, max_rows=MAX_LOOKUP_ROWS
    ):
        """Steps from model tables; tables of more than ``max_rows`` rows are joined.

        The tables are read here, once: a stream that uses the steps batch by batch reads no model again.
        """
        normaliser, scorer = Normaliser(lemmas, max_rows), Scorer(lexicon, rules, max_rows)
        detector = LanguageDetector(profiles, max_rows) if profiles is not None else None
        resolver = PlaceResolver(gazetteer, max_rows) if gazetteer is not None else None
        # A lemma could be empty only if the table says so.
        keeps = not normaliser.blanks()
        joins = any(model.joins for model in (normaliser, scorer, detector) if model is not None)
        detect = detector.detect if detector is not None else None
        return cls(normaliser.normalise, detect, scorer.score, resolver, keeps, joins)


def enrich(df: DataFrame, enrichers: Enrichers, text="text", row_key=("tid",), keep_text=True) -> DataFrame:
    """Content, language and nine-point score of posts with a stripped ``text``.

    Where a step joins, each step gets a table, which goes when the next one is written. ``keep_text=False`` says that
    the text is not needed any more: these tables then have no text beside its content.
    """
    key, out, table = list(row_key), df, None
    if enrichers.joins and not keep_text:
        out, text = df.withColumnRenamed(text, "content"), "content"
    steps = [(enrichers.normaliser, text, "content"), (enrichers.detector, "content", "lang"), (enrichers.scorer, "content", "_compound")]
    for step, source, name in steps:
        if enrichers.joins:
            rows = stored_rows(out)
            if table is not None and table is not rows:
                free(table)
            out, table = rows, hand_over(rows) if rows is not df else None
        out = step(out, source, key, name)
    return out.withColumn("score", score_bin("_compound")).drop("_compound", ROW)


def ingest_posts(lines: DataFrame, enrichers: Enrichers, geo_only=False, mode="regex") -> DataFrame:
    """Clean posts from raw lines.

    Cheap filters come first: ids, missing text, and for ``geo_only`` missing places. With models
    of normal size the whole job is one map stage.
    """
    located = located_posts(lines, enrichers, geo_only, mode)
    posts = enrich(located, enrichers, keep_text=False)
    if enrichers.joins:
        # The steps have tables of their own.
        free(*located.reads)
    if not enrichers.keeps_text:
        posts = require(posts, ["content"])
    return posts.select(*POST_COLUMNS)


def located_posts(lines: DataFrame, enrichers: Enrichers, geo_only=False, mode="regex") -> DataFrame:
    """Posts from raw lines with ``_id``, stripped text and region, after all filters but that of empty content.

    The attribute ``reads`` of the frame lists the tables that were written for it.
    """
    posts = valid_id(extract_fields(lines, mode)).where(F.col("text").isNotNull())
    posts = require(posts, ["author", "date"])
    if geo_only:
        posts = keep_geo(posts)
    others = [c for c in posts.columns if c != "text"]
    posts = computed_once(posts, strip_social("text").alias("text"), keep=others)
    posts = posts.where(F.rlike("text", F.lit(rf"[^{SPACE}]")))
    posts = posts.withColumn("_place", normalise_location(F.lower("location")))
    reads = []
    if enrichers.joins:
        posts = with_row_id(posts)
        reads.append(posts)
    posts = enrichers.resolver.resolve(posts, "_place", ["tid"], "_match")
    posts = posts.withColumn("sal", F.col("_match.sal")).drop("_match", "_place")
    if geo_only:
        posts = require(posts, ["sal"])
    posts = posts.withColumn("_id", F.concat_ws(":", id_partition("tid").cast("string"), "tid"))
    posts.reads = reads
    return posts


def ingest_job(spark: SparkSession, path, store, enrichers, geo_only=False, mode="regex") -> DataFrame:
    """Read a dump, clean it and store what is new, one folder per id partition.

    A post whose ``_id`` is stored already, or that comes again in the dump, is a conflict and is not
    stored; the first by date and then by its fields stays. Returns the conflicts: ``_id, rejected``.

    Posts are written down once. Stored ids are looked up through the store's key index, which
    reads the files that may hold one of the new ids, and is brought up to date at the end. Where no step empties a
    text, content, language and score are made only for posts that may be stored.
    """
    lines, reads, partition = read_post_lines(spark, path), [], F.substring_index("_id", ":", 1).cast("int")
    if enrichers.keeps_text:
        posts = located_posts(lines, enrichers, geo_only, mode)
        reads = posts.reads

        def finish(df):
            return enrich(df, enrichers, keep_text=False).select(*POST_COLUMNS).withColumn("partition", partition)
    else:
        posts, finish = ingest_posts(lines, enrichers, geo_only, mode), None
    posts = posts.drop(ROW).withColumn("partition", partition)
    # An empty store, so that the first dump can look for stored ids.
    made = posts if finish is None else finish(posts.limit(0))
    made.limit(0).write.mode("ignore").partitionBy("partition").parquet(store)
    index = KeyIndex(spark, store)

    def known(ids):
        return index.known(ids.select("_id", partition.alias("partition")))

    inserted, conflicts = bulk_insert(None, posts, "date", known=known, finish=finish)
    write_batched(inserted.drop("version"), store, partition_by=["partition"])
    index.update()
    free(*reads)
    return conflicts


def gazetteer_job(spark: SparkSession, path, out) -> DataFrame:
    """Place dictionary file to stored gazetteer."""
    gazetteer = build_gazetteer(read_place_dict(spark, path).drop("ste"))
    save_gazetteer(gazetteer, out)
    return spark.read.parquet(out)


def topic_region_table(posts, regions, code, state_col, state=STATE_OF_INTEREST, topics=None, by="sal"):
    """Counts and average scores of all topics per region of one state."""
    topics = topics or TOPICS
    metrics = topic_views(posts, topics, by).withColumnRenamed(by, code)
    table = region_metrics(in_state(regions, state, state_col), {"posts": metrics}, code)
    return drop_all_null(table, topic_columns(topics))


def topic_columns(topics=None):
    names = list(topics or TOPICS)
    return [f"count {t}" for t in names] + [f"average_sentiment({t})" for t in names]


def topic_map_job(posts, regions, code, name, state_col, state=STATE_OF_INTEREST, topics=None, by="sal"):
    """Map layers of all topic metrics."""
    table = topic_region_table(posts, regions, code, state_col, state, topics, by)
    cols = topic_columns(topics)
    return metric_layers(table.select(code, name, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]), [code, name], cols)


def crime_table(official, metrics=None, total=TOTAL_OFFENCES) -> DataFrame:
    """Cleaned crime table with the total of all offences.

    The fences come from all areas, before any join with boundaries. The table without repeats is
    written down once: description, filter and all that follows read it from there.
    """
    metrics = OFFENCES if metrics is None else metrics
    cols = list(metrics.values())
    numbers = [f.name for f in official.schema if isinstance(f.dataType, NumericType)]
    clean = checkpointed(fill_zero(official, numbers).dropDuplicates().withColumnsRenamed(metrics))
    return row_sum(drop_outliers(clean, cols), cols, total)


def crime_map_job(official, regions, code, region_code, id_cols, metrics=None, total=TOTAL_OFFENCES):
    """Map layers of the crime table."""
    merged = join_regions(crime_table(official, metrics, total), regions, code, region_code)
    return metric_layers(merged, id_cols, [*(metrics or OFFENCES).values(), total])


def crime_summary(official, metrics=None, total=TOTAL_OFFENCES):
    """Description of the offences that are left after cleaning."""
    return describe5(crime_table(official, metrics, total), [*(metrics or OFFENCES).values(), total])


def income_table(official, regions, code, region_code, state_col, state=STATE_OF_INTEREST, metrics=None, fenced=None):
    """Cleaned income table of one state.

    Joined and filtered first, so areas elsewhere do not move the fences; the age column takes no
    part in outlier removal.
    """
    metrics, fenced = metrics or INCOME_METRICS, fenced or INCOME_FENCED
    clean = drop_any_null(official).dropDuplicates()
    areas = join_regions(clean, in_state(regions, state, state_col), code, region_code)
    return drop_outliers(checkpointed(areas.dropDuplicates()), fenced)


def income_map_job(official, regions, code, region_code, id_cols, state_col, state=STATE_OF_INTEREST, metrics=None, fenced=None):
    metrics = metrics or INCOME_METRICS
    table = income_table(official, regions, code, region_code, state_col, state, metrics, fenced)
    return metric_layers(table, id_cols, metrics)


def scenario_job(posts, official, code, metrics, topics=None, by="sal", official_code=None) -> dict[str, DataFrame]:
    """Posts against an official table, area by area.

    Returns ``table`` (topic metrics and official metrics of the areas both know), ``bands`` (areas by
    count of posts, for each topic), ``correlations`` (average sentiment of each topic with each official
    metric) and ``extremes`` (area with the greatest and least value of every metric).
    """
    topics = topics or TOPICS
    official_code = official_code or code
    areas = official.select(F.col(official_code).cast("string").alias(code), *[F.col(m).cast("double").alias(m) for m in metrics])
    seen = topic_views(posts, topics, by).withColumnRenamed(by, code).withColumn(code, F.col(code).cast("string"))
    # One row for each area, used by three reports.
    table = checkpointed(seen.join(areas, code))
    bands = [count_bands(table, f"`count {t}`").withColumn("topic", F.lit(t)) for t in topics]
    averages = [f"average_sentiment({t})" for t in topics]
    pairs = correlations(table, averages, list(metrics)).withColumnsRenamed({"x": "posts", "y": "official"})
    columns = {c: f"m{i}" for i, c in enumerate([*topic_columns(topics), *metrics])}
    plain = table.select(code, *[F.col(f"`{c}`").cast("double").alias(n) for c, n in columns.items()])
    names = F.create_map(*[F.lit(x) for c, n in columns.items() for x in (n, c)])
    ends = extremes(plain, code, list(columns.values())).withColumn("metric", names[F.col("metric")])
    return {
        "table": table,
        "bands": reduce(DataFrame.unionByName, bands),
        "correlations": pairs,
        "extremes": ends,
    }


def score_distributions(datasets: dict[str, DataFrame], wanted: dict[str, list], topics=None, text="content", score="score"):
    """Score histogram per dataset and topic, with zeros, also for a topic nobody mentions.

    ``wanted`` maps a dataset to its topics; the topic without words stands for all posts.
    """
    words = topics or TOPICS
    parts = []
    for name, posts in datasets.items():
        flags = topic_flags(text, {t: words[t] for t in wanted[name]})
        flagged = posts.select(F.col(score).alias("score"), flags.alias("_topics"))
        # One scan per dataset: posts of each topic are counted per score, then scores become cells.
        counted = flagged.groupBy("score").agg(*[F.count(F.when(F.col("_topics")[t], 1)).alias(t) for t in wanted[name]])
        cells = {(t, s): f"{t}\t{s}" for t in wanted[name] for s in SCORE_LABELS}
        wide = counted.agg(
            *[F.coalesce(F.sum(F.when(F.col("score") == s, F.col(t))), F.lit(0)).alias(c) for (t, s), c in cells.items()]
        )
        long = wide.unpivot([], list(cells.values()), "cell", "count")
        at = F.split("cell", "\t")
        parts.append(
            long.select(
                F.lit(name).alias("dataset"), at[0].alias("topic"), at[1].cast("int").alias("score"), "count"
            )
        )
    return reduce(DataFrame.unionByName, parts)
