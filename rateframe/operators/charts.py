"""Chart tables out of stored metric rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.fixed_values import CHART_YEARS, MONTH_LABELS, WEEKDAY_LABELS
from rateframe.functions.expressions import numeric_value, percent
from rateframe.operators.documents import written_last


def _of(metrics: DataFrame, collector: str, doc_type: str) -> DataFrame:
    return metrics.filter((F.col("collector") == collector) & (F.col("type") == doc_type))


def _number(key: str) -> Column:
    return F.coalesce(F.max(F.when(F.col("metric_key") == key, F.col("value_double"))), F.lit(0.0))


def _wide(metrics: DataFrame, pattern: str, fields: list[str]) -> DataFrame:
    """One row per name in ``pattern`` group 1, one struct of values per field in group 2."""
    value = F.struct("value_double", "value_string")
    return (
        metrics.select(
            F.regexp_extract("metric_key", pattern, 1).alias("name"),
            F.regexp_extract("metric_key", pattern, 2).alias("field"),
            value.alias("value"),
            "seq",
            "label",
        )
        .filter(F.col("name") != "")
        .groupBy("name")
        .pivot("field", fields)
        .agg(F.max_by("value", written_last()))
    )


def _double(field: str) -> Column:
    return F.coalesce(F.col(f"{field}.value_double"), F.lit(0.0))


def _label(position: Column, labels: tuple[str, ...]) -> Column:
    return F.try_element_at(F.array(*[F.lit(x) for x in labels]), position)


def chart_rating_distribution(metrics: DataFrame) -> DataFrame:
    rows = _of(metrics, "RATING_DISTRIBUTION", "RATING_DISTRIBUTION")
    total = rows.agg(_number("totalRatings").alias("total")).scalar()
    rating = F.regexp_extract("metric_key", "^rating_(.+)$", 1)
    return (
        rows.select(rating.alias("shown"), F.col("value_double").alias("ratingCount"))
        .filter(F.col("shown") != "")
        .withColumn("total", total)
        .select(
            F.col("shown").cast("double").alias("rating"),
            F.concat("shown", F.lit("★")).alias("label"),
            F.col("ratingCount").cast("bigint").alias("ratingCount"),
            F.round(percent("ratingCount", "total"), 1).alias("percentage"),
        )
        .orderBy("rating")
    )


def chart_engagement(metrics: DataFrame) -> DataFrame:
    rows = _of(metrics, "USER_ENGAGEMENT", "USER_ENGAGEMENT")
    tiers = (
        ("Low Engaged", "lowEngagedUsers"),
        ("Moderately Engaged", "moderatelyEngagedUsers"),
        ("Highly Engaged", "highlyEngagedUsers"),
    )
    one = rows.agg(_number("totalEngagedUsers").alias("total"), *[_number(key).alias(key) for _, key in tiers])
    listed = F.array(*[F.struct(F.lit(n).alias("name"), F.col(key).alias("value")) for n, key in tiers])
    return (
        one.filter(F.col("total") > 0)
        .select("total", F.inline(listed))
        .select(
            "name",
            F.col("value").cast("bigint").alias("value"),
            F.round(percent("value", "total"), 1).alias("percentage"),
        )
    )


def chart_segmentation(metrics: DataFrame) -> DataFrame:
    rows = _of(metrics, "USER_SEGMENTATION", "USER_SEGMENTATION")
    levels, patterns = ("Low", "Medium", "High"), ("Critical", "Neutral", "Positive")
    one = rows.agg(
        F.array(*[
            F.struct(
                F.lit(level).alias("activity"),
                *[_number(f"segment_{level}_{p}").cast("bigint").alias(p.lower()) for p in patterns],
            )
            for level in levels
        ]).alias("rows")
    )
    return one.select(F.inline("rows"))


def chart_top_movies(metrics: DataFrame, k: int = 5) -> DataFrame:
    rows = _of(metrics, "CONTENT_ANALYTICS", "MOVIE_POPULARITY")
    fields = ["title", "ratingsCount", "avgRating", "genres"]
    return (
        _wide(rows, r"^topMovie_(\d+)_(title|ratingsCount|avgRating|genres)$", fields)
        .select(
            F.col("name").cast("int").alias("movieId"),
            F.col("title.value_string").alias("title"),
            _double("ratingsCount").cast("bigint").alias("ratings"),
            F.col("avgRating.value_double").alias("avgRating"),
            F.col("genres.value_string").alias("genres"),
        )
        .filter(F.col("title").isNotNull() & (F.col("title") != "") & (F.col("title") != "N/A"))
        .orderBy(F.desc("ratings"), "movieId")
        .limit(k)
    )


def _genres(metrics: DataFrame) -> DataFrame:
    rows = _of(metrics, "CONTENT_ANALYTICS", "GENRE_DISTRIBUTION")
    shown = F.coalesce(F.col("name_.value_string"), F.initcap("name"))
    return (
        _wide(
            rows.withColumn("metric_key", F.regexp_replace("metric_key", "_name$", "_name_")),
            r"^genre_(.+)_(name_|count|avgRating|uniqueUsers)$",
            ["name_", "count", "avgRating", "uniqueUsers"],
        )
        .select(
            shown.alias("genre"),
            _double("count").cast("bigint").alias("ratingCount"),
            _double("avgRating").alias("avgRating"),
            _double("uniqueUsers").cast("bigint").alias("uniqueUsers"),
        )
    )


def chart_genre_popularity(metrics: DataFrame, k: int = 12) -> DataFrame:
    return _genres(metrics).orderBy(F.desc("ratingCount"), "genre").limit(k)


def chart_genre_quality(metrics: DataFrame, more_than: int = 50000, k: int = 10) -> DataFrame:
    return (
        _genres(metrics)
        .select("genre", "avgRating", "ratingCount")
        .filter(F.col("ratingCount") > more_than)
        .orderBy(F.desc("avgRating"), "genre")
        .limit(k)
    )


def _temporal(metrics: DataFrame, stem: str, fields: list[str]) -> DataFrame:
    rows = _of(metrics, "TEMPORAL_TRENDS", "TEMPORAL_TRENDS")
    wide = _wide(rows, rf"^{stem}_(\d+)_({'|'.join(fields)})$", fields)
    return wide.select(
        F.col("name").cast("int").alias("part"),
        _double("count").cast("bigint").alias("ratingCount"),
        _double("avgRating").alias("avgRating"),
        *([_double("activeUsers").cast("bigint").alias("activeUsers")] if "activeUsers" in fields else []),
    )


def chart_monthly(metrics: DataFrame) -> DataFrame:
    return (
        _temporal(metrics, "month", ["count", "avgRating"])
        .orderBy("part")
        .select(_label(F.col("part"), MONTH_LABELS).alias("month"), "ratingCount", "avgRating")
    )


def chart_yearly(metrics: DataFrame, years: tuple[int, int] | None = CHART_YEARS) -> DataFrame:
    """Years from the first to the last of ``years``, or all."""
    return (
        _temporal(metrics, "year", ["count", "avgRating", "activeUsers"])
        .filter(F.col("part").between(*years) if years else F.lit(True))
        .orderBy("part")
        .withColumnRenamed("part", "year")
    )


def chart_weekly(metrics: DataFrame) -> DataFrame:
    return (
        _temporal(metrics, "dayOfWeek", ["count", "avgRating"])
        .orderBy("part")
        .select(_label(F.col("part"), WEEKDAY_LABELS).alias("day"), "ratingCount", "avgRating")
    )


def metric_numeric_value(stored: DataFrame, column: str = "raw") -> DataFrame:
    return stored.withColumn("value", numeric_value(column))
