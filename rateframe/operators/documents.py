"""Analytics documents: building, storing, querying and counting them.

A stored document has analyticsId, generatedAtMicros, type and description, and may carry more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rateframe.fixed_values import (
    ANALYTICS_TYPES,
    DOCUMENTS,
    GENRE_FALLBACK_PREFIX,
    GENRE_FALLBACK_TEXT,
)
from rateframe.functions.expressions import percent
from rateframe.operators.paging import page_of


def analytics_type_catalog(spark: SparkSession) -> DataFrame:
    catalog = spark.createDataFrame(list(ANALYTICS_TYPES), "type string, category string, typeDescription string")
    return catalog.select(
        "*",
        (F.col("category") == "Data Quality").alias("isDataQuality"),
        (F.col("category") == "User Behavior").alias("isUserBehavior"),
        (F.col("category") == "Content Analytics").alias("isContentAnalytics"),
        (F.col("category") == "System Performance").alias("isSystemPerformance"),
    )


# --- building -----------------------------------------------------------------

def written_last() -> Column:
    """Orders metrics under one key; the highest is the one a document and a chart show."""
    return F.struct("seq", F.coalesce("label", F.lit("")))


def analytics_documents(metrics: DataFrame, run_id: str, generated_at_micros: int) -> DataFrame:
    """One document per (collector, type) with its metrics as a map of typed values.

    Of two metrics under one key the one written last stays. A map holds as many entries as
    the collector has metric keys, which follows the number of genres and years, not of ratings.
    """
    spark = metrics.sparkSession
    value = F.struct("value_double", "value_string", "value_bool")
    headers = spark.createDataFrame(list(DOCUMENTS), "collector string, prefix string, type string, description string")
    kept = metrics.groupBy("collector", "type", "metric_key").agg(F.max_by(value, written_last()).alias("value"))
    maps = kept.groupBy("collector", "type").agg(
        F.map_from_entries(F.collect_list(F.struct("metric_key", "value"))).alias("metrics")
    )
    has_genres = F.try_element_at("metrics", F.lit("genreDataAvailable"))["value_bool"]
    no_movies = F.coalesce((F.col("type") == "GENRE_DISTRIBUTION") & ~has_genres, F.lit(False))
    prefix = F.when(no_movies, GENRE_FALLBACK_PREFIX).otherwise(F.col("prefix"))
    return (
        maps.join(F.broadcast(headers), ["collector", "type"])
        .join(F.broadcast(analytics_type_catalog(spark).select("type", "category")), "type")
        .select(
            F.concat(prefix, F.lit("_" + run_id)).alias("analyticsId"),
            F.lit(generated_at_micros).cast("bigint").alias("generatedAtMicros"),
            "collector",
            "type",
            "category",
            F.when(no_movies, GENRE_FALLBACK_TEXT).otherwise(F.col("description")).alias("description"),
            "metrics",
        )
    )


def metrics_of(documents: DataFrame) -> DataFrame:
    """The metric map of each document as rows."""
    return documents.select(
        "analyticsId", "collector", "type", F.explode("metrics").alias("metric_key", "value")
    ).select("analyticsId", "collector", "type", "metric_key", "value.*")


# --- storing --------------------------------------------------------------------

def keep_latest(df: DataFrame, key: str, *newest_first: Column) -> DataFrame:
    """One row per key. Each task drops all but its own newest row before anything is shuffled."""
    order = Window.partitionBy(key).orderBy(*newest_first)
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") == 1).drop("_rank")


def analytics_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming documents replace stored ones with the same id; of several, the newest stays."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    latest = keep_latest(
        both, "analyticsId", F.desc("_new"), F.desc("generatedAtMicros"), F.asc("type"), F.asc("description")
    )
    return latest.drop("_new")


def upsert_counts(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """How many keys an upsert adds and how many it replaces."""
    stored = existing.select(key).distinct().withColumn("stored", F.lit(True))
    return (
        incoming.select(key)
        .distinct()
        .join(stored, key, "left")
        .agg(
            F.count_if(F.col("stored").isNull()).alias("inserted"),
            F.count_if("stored").alias("updated"),
        )
    )


# --- querying -------------------------------------------------------------------

SORT_FIELDS = {
    "generatedAt": "generatedAtMicros",
    "analyticsId": "analyticsId",
    "type": "type",
    "description": "description",
}
MAX_PAGE_SIZE = 100
# Pages that end within so many rows are top lists.
SHALLOW_ROWS = 10_000


def matching_documents(
    docs: DataFrame,
    analytics_id: str | None = None,
    types: Sequence[str] | None = None,
    from_micros: int | None = None,
    to_micros: int | None = None,
    keyword: str | None = None,
) -> DataFrame:
    """The first filter that applies decides: id, types and/or dates, keyword, none.

    Both ends of a date range are exclusive; either may be open. The keyword is a
    case-insensitive pattern searched in the description.
    """
    if analytics_id is not None:
        return docs.filter(F.col("analyticsId") == analytics_id)
    has_dates = from_micros is not None or to_micros is not None
    if types or has_dates:
        out = docs.filter(F.col("type").isin(*types)) if types else docs
        if has_dates:
            out = out.filter(F.col("generatedAtMicros") > (from_micros or 0))
            if to_micros is not None:
                out = out.filter(F.col("generatedAtMicros") < to_micros)
        return out
    if keyword is not None:
        return docs.filter(F.col("description").rlike("(?i)" + keyword))
    return docs


def _check_page(page: int, size: int) -> None:
    if page < 0:
        raise ValueError(f"page must not be negative: {page}")
    if not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError(f"size must be between 1 and {MAX_PAGE_SIZE}: {size}")


def analytics_query(
    docs: DataFrame,
    sort_by: str = "generatedAt",
    ascending: bool = False,
    page: int = 0,
    size: int = 20,
    **filters,
) -> DataFrame:
    """One page of matching documents in order; documents that tie are ordered by id. Deep pages come from a sorted copy."""
    _check_page(page, size)
    field = F.col(SORT_FIELDS[sort_by])
    order = (field.asc() if ascending else field.desc(), F.asc("analyticsId"))
    return page_of(matching_documents(docs, **filters), order, page * size, size, SHALLOW_ROWS)


def analytics_count(docs: DataFrame, page: int = 0, size: int = 20, **filters) -> DataFrame:
    _check_page(page, size)
    pages = F.ceil(F.col("totalElements") / size)
    return (
        matching_documents(docs, **filters)
        .agg(F.count("*").alias("totalElements"))
        .select(
            "totalElements",
            pages.alias("totalPages"),
            (F.lit(page) < pages - 1).alias("hasNext"),
            F.lit(page > 0).alias("hasPrevious"),
        )
    )


def analytics_by_id(docs: DataFrame, analytics_id: str) -> DataFrame:
    return matching_documents(docs, analytics_id=analytics_id)


def analytics_counts_by_type(docs: DataFrame) -> DataFrame:
    """Documents per known type with its category and description."""
    catalog = analytics_type_catalog(docs.sparkSession).select("type", "category", "typeDescription")
    counts = docs.groupBy("type").agg(F.count("*").alias("documents"))
    return counts.join(F.broadcast(catalog), "type").select("type", "category", "typeDescription", "documents")


def analytics_counts_by_category(counts_by_type: DataFrame) -> DataFrame:
    return counts_by_type.groupBy("category").agg(F.sum("documents").alias("documents"))


def analytics_summary(docs: DataFrame) -> DataFrame:
    """One row per category: its count and share, next to totals over all documents."""
    per_type = docs.groupBy("type").agg(
        F.count("*").alias("documents"),
        F.max("generatedAtMicros").alias("latest"),
        F.min("generatedAtMicros").alias("oldest"),
    )
    catalog = analytics_type_catalog(docs.sparkSession).select("type", "category")
    overall = per_type.agg(
        F.struct(
            F.sum("documents").alias("total"),
            F.count("*").alias("types"),
            F.max("latest").alias("latest"),
            F.min("oldest").alias("oldest"),
        ).alias("all")
    )
    return (
        per_type.join(F.broadcast(catalog), "type")
        .groupBy("category")
        .agg(F.sum("documents").alias("categoryCount"))
        .withColumn("all", overall.scalar())
        .select(
            F.col("all.total").alias("totalAnalytics"),
            F.col("all.types").alias("uniqueTypes"),
            F.col("all.latest").alias("latestMicros"),
            F.col("all.oldest").alias("oldestMicros"),
            "category",
            "categoryCount",
            percent("categoryCount", "all.total").alias("categoryPercentage"),
        )
    )


def analytics_exists_by_type(docs: DataFrame) -> DataFrame:
    """Every known type and whether any document has it."""
    stored = docs.select("type").distinct().withColumn("exists", F.lit(True))
    catalog = analytics_type_catalog(docs.sparkSession).select("type")
    return catalog.join(stored, "type", "left").select("type", F.coalesce("exists", F.lit(False)).alias("exists"))


def analytics_latest_by_type(docs: DataFrame) -> DataFrame:
    return keep_latest(docs, "type", F.desc("generatedAtMicros"), F.asc("analyticsId"))
