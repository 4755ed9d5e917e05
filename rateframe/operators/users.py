"""User activity, engagement and segmentation.

One profile row per user; one overview row over all profiles; one small cube of segments.
A report that needs a few columns of the overview pays only for those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.functions.expressions import count_where, ladder, percent, share
from rateframe.operators.facts import direct_facts, folded, mean, sample_stddev


def user_profile(pairs: DataFrame) -> DataFrame:
    """Count, mean, deviation, distinct movies and time span per user, out of pair facts."""
    return _profile(
        pairs.groupBy("userId").agg(
            *folded(),
            F.count("*").alias("uniqueMovies"),
            F.min("minTimestamp").alias("minTimestamp"),
            F.max("maxTimestamp").alias("maxTimestamp"),
        )
    )


def user_profile_of_ratings(ratings: DataFrame) -> DataFrame:
    """The same straight from the ratings, for reports that may not need the distinct movies."""
    return _profile(direct_facts(ratings, "userId", "movieId", "uniqueMovies"))


def _profile(facts: DataFrame) -> DataFrame:
    return facts.select(
        "userId",
        F.col("n").alias("totalRatings"),
        mean().alias("avgRating"),
        sample_stddev().alias("ratingStdDev"),
        "uniqueMovies",
        "minTimestamp",
        "maxTimestamp",
        (F.col("maxTimestamp") - F.col("minTimestamp")).alias("engagementSpan"),
    )


def activity_level() -> Column:
    return ladder(F.col("totalRatings"), ((100, "High"), (20, "Medium")), "Low")


def rating_pattern() -> Column:
    return ladder(F.col("avgRating"), ((4.0, "Positive"), (2.5, "Neutral")), "Critical")


def _movies_per_rating(top: str, middle: str, rest: str) -> Column:
    distinct, n = F.col("uniqueMovies"), F.col("totalRatings")
    return F.when(distinct > n * 0.8, top).when(distinct > n * 0.5, middle).otherwise(rest)


def profile_overview(profile: DataFrame) -> DataFrame:
    """One pass over the profiles, one row: what the summaries below pick from."""
    n, distinct = F.col("totalRatings"), F.col("uniqueMovies")
    level, pattern = activity_level(), rating_pattern()
    return profile.agg(
        F.count("*").alias("users"),
        F.avg(n).alias("avgRatings"),
        F.min(n).alias("minRatings"),
        F.max(n).alias("maxRatings"),
        F.percentile_approx(n, 0.5).alias("medianRatings"),
        F.stddev_samp(n).alias("stdDevRatings"),
        F.avg("avgRating").alias("avgAvgRating"),
        F.stddev_samp("avgRating").alias("stdDevAvgRating"),
        F.avg("ratingStdDev").alias("avgStdDev"),
        F.avg(distinct).alias("avgDistinct"),
        F.max(distinct).alias("maxDistinct"),
        F.percentile_approx(distinct, 0.5).alias("medianDistinct"),
        F.avg("engagementSpan").alias("avgSpan"),
        count_where(n > 50).alias("above50"),
        count_where(n.between(10, 50)).alias("from10to50"),
        count_where(n < 10).alias("below10"),
        count_where(level == "High").alias("high"),
        count_where(level == "Medium").alias("medium"),
        count_where(level == "Low").alias("low"),
        count_where(pattern == "Positive").alias("positive"),
        count_where(pattern == "Neutral").alias("neutral"),
        count_where(pattern == "Critical").alias("critical"),
    )


def user_activity_summary(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("users").alias("totalUsers"),
        F.col("avgRatings").alias("avgRatingsPerUser"),
        F.col("minRatings").alias("minRatingsPerUser"),
        F.col("maxRatings").alias("maxRatingsPerUser"),
        F.col("medianRatings").alias("medianRatingsPerUser"),
    )


def top_users(profile: DataFrame, k: int = 10) -> DataFrame:
    return (
        profile.select("userId", F.col("totalRatings").alias("ratingsCount"))
        .orderBy(F.desc("ratingsCount"), "userId")
        .limit(k)
    )


def user_engagement_summary(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("avgRatings").alias("avgRatingsPerUser"),
        F.col("avgAvgRating").alias("avgUserRating"),
        F.coalesce("avgStdDev", F.lit(0.0)).alias("avgRatingStdDev"),
        F.col("avgDistinct").alias("avgUniqueMoviesPerUser"),
        F.col("avgSpan").alias("avgEngagementSpanSeconds"),
    )


def _share_of_users(part: str) -> Column:
    return F.coalesce(percent(part, "users"), F.lit(0.0))


def engagement_tiers(over: DataFrame) -> DataFrame:
    """More than 50, 10 to 50, and fewer than 10 ratings."""
    return over.select(
        F.col("above50").alias("highlyEngagedUsers"),
        F.col("from10to50").alias("moderatelyEngagedUsers"),
        F.col("below10").alias("lowEngagedUsers"),
        F.col("users").alias("totalEngagedUsers"),
        _share_of_users("above50").alias("highEngagementPercentage"),
        _share_of_users("from10to50").alias("moderateEngagementPercentage"),
        _share_of_users("below10").alias("lowEngagementPercentage"),
    )


def activity_levels(over: DataFrame) -> DataFrame:
    levels, patterns = ("high", "medium", "low"), ("positive", "neutral", "critical")
    return over.select(
        F.col("users").alias("totalUsers"),
        *[F.col(x).alias(f"{x}ActivityUsers") for x in levels],
        *[F.col(x).alias(f"{x}Users") for x in patterns],
        *[_share_of_users(x).alias(f"{x}ActivityPercentage") for x in levels],
        *[_share_of_users(x).alias(f"{x}UsersPercentage") for x in patterns],
    )


def segment_variation(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("avgRatings").alias("avgRatingsAcrossUsers"),
        F.col("avgAvgRating").alias("avgRatingAcrossUsers"),
        F.col("avgDistinct").alias("avgUniqueMoviesAcrossUsers"),
        F.coalesce("stdDevRatings", F.lit(0.0)).alias("activityVariation"),
        F.coalesce("stdDevAvgRating", F.lit(0.0)).alias("ratingVariation"),
    )


def segmentation_score(over: DataFrame) -> DataFrame:
    """The more users one activity level holds, the lower the score."""
    largest = F.greatest(share("high", "users"), share("medium", "users"), share("low", "users")) * 100
    penalty = ladder(F.col("maxSegmentPercentage"), ((80.0, 30.0), (70.0, 20.0), (60.0, 10.0)), 0.0)
    return over.select(F.coalesce(largest, F.lit(0.0)).alias("maxSegmentPercentage")).select(
        "maxSegmentPercentage", (100.0 - penalty).alias("segmentationEffectivenessScore")
    )


def engagement_quality(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("medianRatings").alias("medianRatingsPerUser"),
        F.col("medianDistinct").alias("medianUniqueMoviesPerUser"),
        F.col("maxRatings").alias("maxRatingsPerUser"),
        F.col("maxDistinct").alias("maxUniqueMoviesPerUser"),
    )


def engagement_consistency(over: DataFrame) -> DataFrame:
    penalty = ladder(F.col("avgStdDev"), ((2.0, 30.0), (1.5, 20.0), (1.0, 10.0)), 0.0)
    return over.select((100.0 - penalty).alias("engagementConsistencyScore"))


def segment_cube(profile: DataFrame) -> DataFrame:
    """Users per combination of the six segment labels: at most 972 rows that answer three reports."""
    spread = F.col("ratingStdDev")
    consistency = F.when(spread < 0.5, "Consistent").when(spread < 1.0, "Moderate").otherwise("Variable")
    frequency = ladder(
        F.col("totalRatings"), ((100, "VeryActive"), (50, "Active"), (10, "Moderate")), "Casual"
    )
    labels = {
        "activityLevel": activity_level(),
        "ratingPattern": rating_pattern(),
        "engagementLevel": _movies_per_rating("Explorer", "Selective", "Focused"),
        "ratingConsistency": consistency,
        "ratingFrequency": frequency,
        "ratingDiversity": _movies_per_rating("HighDiversity", "ModerateDiversity", "LowDiversity"),
    }
    return (
        profile.select(*[label.alias(name) for name, label in labels.items()])
        .groupBy(*labels)
        .agg(F.count("*").alias("users"))
    )


def _segments(cube: DataFrame, *labels: str) -> DataFrame:
    return cube.groupBy(*labels).agg(F.sum("users").alias("users"))


def segment_matrix(cube: DataFrame) -> DataFrame:
    return _segments(cube, "activityLevel", "ratingPattern")


def advanced_segments(cube: DataFrame) -> DataFrame:
    return _segments(cube, "engagementLevel", "ratingConsistency")


def rating_behavior_matrix(cube: DataFrame) -> DataFrame:
    return _segments(cube, "ratingFrequency", "ratingDiversity")
