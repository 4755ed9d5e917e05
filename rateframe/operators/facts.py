"""Ratings folded to one row per (user, movie): the common base of user, movie and genre reports.

The fold happens on the map side first, so neither a user nor a movie that holds a large part of
all ratings ends up in one task. Counting rows of this table per user or movie is then a distinct
count, which saves every later report its own pass and shuffle over the ratings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pair_facts(ratings: DataFrame) -> DataFrame:
    rating, at = F.col("ratingActual"), F.col("timestampEpochSeconds")
    return ratings.groupBy("userId", "movieId").agg(
        F.count("*").alias("rows"),
        F.count(rating).alias("n"),
        F.sum(rating).alias("total"),
        F.sum(rating * rating).alias("totalSquares"),
        F.min(rating).alias("minRating"),
        F.max(rating).alias("maxRating"),
        F.min(at).alias("minTimestamp"),
        F.max(at).alias("maxTimestamp"),
    )


def direct_facts(ratings: DataFrame, key: str, other: str, distinct: str) -> DataFrame:
    """Ratings folded straight to one row per ``key``, and the distinct values of ``other`` as ``distinct``.

    A report that does not read ``distinct`` pays for one shuffle of one row per key and task; only the
    distinct count makes Spark fold by both columns first.
    """
    rating, at = F.col("ratingActual"), F.col("timestampEpochSeconds")
    return ratings.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.count(rating).alias("n"),
        F.sum(rating).alias("total"),
        F.sum(rating * rating).alias("totalSquares"),
        F.count_distinct(other).alias(distinct),
        F.min(rating).alias("minRating"),
        F.max(rating).alias("maxRating"),
        F.min(at).alias("minTimestamp"),
        F.max(at).alias("maxTimestamp"),
    )


def single_facts(ratings: DataFrame) -> DataFrame:
    """Each rating as the facts of itself, for reports that fold only once."""
    rating = F.col("ratingActual")
    n = F.when(rating.isNotNull(), F.lit(1)).otherwise(F.lit(0)).cast("bigint")
    return ratings.select("userId", "movieId", n.alias("n"), rating.alias("total"), (rating * rating).alias("totalSquares"))


def folded() -> list[Column]:
    """Aggregates that add facts up to a coarser key."""
    return [F.sum(c).alias(c) for c in ("n", "total", "totalSquares")]


def mean() -> Column:
    return F.col("total") / F.nullif(F.col("n"), F.lit(0))


def sample_stddev() -> Column:
    """From count, sum and sum of squares; null below two ratings.

    For half-star ratings all three are exact, so equal ratings give exactly zero.
    """
    n = F.col("n").cast("double")
    spread = F.greatest(n * F.col("totalSquares") - F.col("total") * F.col("total"), F.lit(0.0))
    return F.when(n > 1, F.sqrt(spread / (n * (n - 1))))
