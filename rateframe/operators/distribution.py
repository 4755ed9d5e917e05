"""How rating values are distributed. Everything but stddev follows from one small histogram."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.functions.expressions import percent


def rating_histogram(ratings: DataFrame) -> DataFrame:
    """Rows per rating value. Sort the result where order matters: it has one row per value."""
    return (
        ratings.filter(F.col("ratingActual").isNotNull())
        .groupBy("ratingActual")
        .agg(F.count("*").alias("ratingCount"))
    )


def rating_stats(seen: DataFrame) -> DataFrame:
    return seen.select(
        F.col("ratings").alias("totalRatings"), "avgRating", "minRating", "maxRating", "stdDevRating"
    )


def rating_bands(seen: DataFrame) -> DataFrame:
    """High from 4.0, medium 2.5 to 3.9, low below 2.5; what lies between 3.9 and 4.0 is in no band."""
    return seen.select(
        "highRatings",
        "mediumRatings",
        "lowRatings",
        percent("highRatings", "totalRows").alias("highRatingsPercentage"),
        percent("mediumRatings", "totalRows").alias("mediumRatingsPercentage"),
        percent("lowRatings", "totalRows").alias("lowRatingsPercentage"),
    )


def rating_mode(histogram: DataFrame) -> DataFrame:
    """Most and least common value; the lower rating wins a tie."""
    value, n = F.col("ratingActual"), F.col("ratingCount")
    return histogram.agg(
        F.count("*").alias("uniqueRatingValues"),
        F.max_by(value, F.struct(n, -value)).alias("mostCommonRating"),
        F.max(n).alias("mostCommonRatingCount"),
        F.min_by(value, F.struct(n, value)).alias("leastCommonRating"),
        F.min(n).alias("leastCommonRatingCount"),
    )


def rating_quartiles(histogram: DataFrame) -> DataFrame:
    """Exact quartiles, interpolated, with each rating value weighted by its count."""
    quartiles = F.percentile("ratingActual", [0.25, 0.5, 0.75], F.col("ratingCount"))
    return histogram.agg(quartiles.alias("q")).select(
        F.col("q")[0].alias("ratingQ1"),
        F.col("q")[1].alias("ratingMedian"),
        F.col("q")[2].alias("ratingQ3"),
        (F.col("q")[2] - F.col("q")[0]).alias("ratingIQR"),
    )
