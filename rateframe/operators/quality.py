"""Data quality and freshness of ratings.

Most numbers come from :func:`overview`, one pass over the ratings that yields one row.
A caller that needs only a few of them pays only for those: Catalyst drops the rest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.fixed_values import DAY_SECONDS, RATING_MAX, RATING_MIN
from rateframe.functions.expressions import count_where, ladder, percent, sum_of
from rateframe.session import materialize

KEY_COLUMNS = ("userId", "movieId", "ratingActual", "timestampEpochSeconds")


def overview(ratings: DataFrame, as_of: int) -> DataFrame:
    """One row of counts and extremes. ``as_of`` is the epoch second that counts as now."""
    rating, ts = F.col("ratingActual"), F.col("timestampEpochSeconds")
    no_subject = F.col("userId").isNull() | F.col("movieId").isNull() | rating.isNull()
    return ratings.agg(
        F.count("*").alias("totalRows"),
        F.count("userId").alias("userIds"),
        F.count("movieId").alias("movieIds"),
        F.count("ratingActual").alias("ratings"),
        F.count("timestampEpochSeconds").alias("timestamps"),
        F.min(ts).alias("oldest"),
        F.max(ts).alias("newest"),
        F.min(rating).alias("minRating"),
        F.max(rating).alias("maxRating"),
        F.avg(rating).alias("avgRating"),
        F.stddev_samp(rating).alias("stdDevRating"),
        count_where(rating >= 4.0).alias("highRatings"),
        count_where(rating.between(2.5, 3.9)).alias("mediumRatings"),
        count_where(rating < 2.5).alias("lowRatings"),
        count_where(ts > as_of).alias("futureTimestamps"),
        count_where(ts < 0).alias("invalidTimestamps"),
        count_where(no_subject).alias("nullRecords"),
        count_where(~no_subject & ts.isNotNull()).alias("validRows"),
    )


def dq_completeness(seen: DataFrame) -> DataFrame:
    parts = {
        "userIdCompleteness": percent("userIds", "totalRows"),
        "movieIdCompleteness": percent("movieIds", "totalRows"),
        "ratingCompleteness": percent("ratings", "totalRows"),
        "timestampCompleteness": percent("timestamps", "totalRows"),
    }
    return seen.select(
        "totalRows",
        *[value.alias(name) for name, value in parts.items()],
        (sum_of(parts.values()) / 4).alias("overallCompleteness"),
    )


def dq_duplicates(ratings: DataFrame) -> DataFrame:
    """Exact copies. Copies are folded on the map side before the shuffle."""
    return (
        ratings.groupBy(*KEY_COLUMNS)
        .agg(F.count("*").alias("copies"))
        .agg(F.count("*").alias("uniqueRecords"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"))
        .select(
            "uniqueRecords",
            (F.col("rows") - F.col("uniqueRecords")).alias("duplicateRecords"),
            percent(F.col("rows") - F.col("uniqueRecords"), "rows").alias("duplicatePercentage"),
        )
    )


def _span_days() -> Column:
    return F.floor((F.col("newest") - F.col("oldest")) / DAY_SECONDS)


def _span_columns() -> list[Column]:
    per_day = F.col("timestamps") / F.greatest(_span_days(), F.lit(1)).cast("double")
    return [
        F.col("oldest").alias("oldestRatingTimestamp"),
        F.col("newest").alias("newestRatingTimestamp"),
        _span_days().alias("timeSpanDays"),
        per_day.alias("ratingsPerDay"),
        (per_day / 24).alias("ratingsPerHour"),
    ]


def freshness_span(seen: DataFrame) -> DataFrame:
    return seen.select(*_span_columns())


def _recency_of_task(window: int):
    """Count and extremes of a task's times, and how often each second after its newest minus ``window`` occurs.

    Nothing older can be within ``window`` of the newest time of all tasks.
    """

    def fold(batches):
        import numpy as np
        import pyarrow as pa

        n, oldest, newest, held, waiting = 0, None, None, [], 0

        def merged():
            second = np.concatenate([s for s, _ in held])
            count = np.concatenate([c for _, c in held])
            second, place = np.unique(second, return_inverse=True)
            return second, np.bincount(place, weights=count).astype("int64")

        for batch in batches:
            second = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
            if not len(second):
                continue
            n += len(second)
            low, high = int(second.min()), int(second.max())
            oldest, newest = (low, high) if oldest is None else (min(oldest, low), max(newest, high))
            second, count = np.unique(second[second > newest - window], return_counts=True)
            held.append((second, count))
            waiting += len(second)
            if waiting > 1 << 20:
                second, count = merged()
                recent = second > newest - window
                held, waiting = [(second[recent], count[recent])], 0
        names = ["second", "n", "oldest", "newest"]
        kinds = [pa.int64()] * 4
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((None, n, oldest, newest), kinds)], names=names)
        if held:
            second, count = merged()
            recent = second > newest - window
            blank = pa.nulls(int(recent.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(second[recent]), pa.array(count[recent]), blank, blank], names=names)

    return fold


def recency(ratings: DataFrame) -> DataFrame:
    """One row from one pass over the ratings: oldest, newest, timestamps, and how many are strictly newer than 30, 7 and 1
    days before the newest.

    Tasks hand on counts per second of their own last 30 days, at most 2.6 million small rows each. The newest time of
    all then decides which of them count.
    """
    times = ratings.select(F.col("timestampEpochSeconds").cast("bigint").alias("ts"))
    state = times.mapInArrow(_recency_of_task(30 * DAY_SECONDS), "second bigint, n bigint, oldest bigint, newest bigint")
    state = materialize(state, "recency")
    newest = state.agg(F.max("newest")).scalar()

    def after(days: int) -> Column:
        return F.coalesce(F.sum(F.when(F.col("second") > newest - days * DAY_SECONDS, F.col("n"))), F.lit(0))

    return state.agg(
        F.min("oldest").alias("oldest"),
        F.max("newest").alias("newest"),
        F.coalesce(F.sum(F.when(F.col("second").isNull(), F.col("n"))), F.lit(0)).alias("timestamps"),
        after(30).alias("recentRatings30Days"),
        after(7).alias("ratingsLast7Days"),
        after(1).alias("ratingsLast24Hours"),
    )


def recency_after(ratings: DataFrame, seen: DataFrame) -> DataFrame:
    """The row of :func:`recency` where the newest time is known already, from a stored overview: one pass of sums."""
    at, newest = F.col("timestampEpochSeconds").cast("bigint"), seen.select(F.col("newest").cast("bigint")).scalar()

    def after(days: int) -> Column:
        return F.coalesce(F.sum(F.when(at > newest - days * DAY_SECONDS, 1)), F.lit(0))

    return ratings.agg(
        F.min(at).alias("oldest"),
        F.max(at).alias("newest"),
        F.count(at).alias("timestamps"),
        after(30).alias("recentRatings30Days"),
        after(7).alias("ratingsLast7Days"),
        after(1).alias("ratingsLast24Hours"),
    )


def freshness_recent(recent: DataFrame) -> DataFrame:
    """Ratings strictly newer than 30, 7 and 1 days before the newest one."""
    return recent.select(
        "recentRatings30Days",
        percent("recentRatings30Days", "timestamps").alias("recentActivityPercentage"),
        "ratingsLast7Days",
        "ratingsLast24Hours",
        percent("ratingsLast7Days", "timestamps").alias("weeklyActivityPercentage"),
        percent("ratingsLast24Hours", "timestamps").alias("dailyActivityPercentage"),
    )


def dq_freshness(recent: DataFrame) -> DataFrame:
    return recent.select(
        *_span_columns(),
        "recentRatings30Days",
        percent("recentRatings30Days", "timestamps").alias("recentActivityPercentage"),
    )


def freshness_score(seen: DataFrame, as_of: int) -> DataFrame:
    age = F.lit(as_of) - F.col("newest")
    days = (age / DAY_SECONDS).cast("bigint")
    penalty = ladder(days, ((365, 50.0), (90, 30.0), (30, 15.0), (7, 5.0)), 0.0)
    return seen.select(
        age.alias("dataAgeSeconds"), days.alias("dataAgeDays"), (100.0 - penalty).alias("freshnessScore")
    )


def freshness_trend(recent: DataFrame) -> DataFrame:
    day, week = F.col("ratingsLast24Hours"), F.col("ratingsLast7Days")
    return recent.select(
        "ratingsLast24Hours",
        "ratingsLast7Days",
        F.when(day > week / 7.0, "Increasing")
        .when(day < week / 14.0, "Decreasing")
        .otherwise("Stable")
        .alias("activityTrend"),
    )


def _in_range() -> Column:
    return (F.col("minRating") >= RATING_MIN) & (F.col("maxRating") <= RATING_MAX)


def dq_rating_range(histogram: DataFrame) -> DataFrame:
    """From the rating histogram, so the distinct count costs nothing extra."""
    return histogram.agg(
        F.min("ratingActual").alias("minRating"),
        F.max("ratingActual").alias("maxRating"),
        F.count("ratingActual").alias("uniqueRatingValues"),
    ).withColumn("ratingsInValidRange", _in_range())


def dq_orphan_ratings(movie_facts: DataFrame, movies: DataFrame) -> DataFrame:
    """Ratings with and without a movie row; ratings arrive folded to one row per movie."""
    known = movies.select("movieId").distinct().withColumn("known", F.lit(True))
    rows = F.col("rows")
    return (
        movie_facts.join(known, "movieId", "left")
        .agg(
            F.coalesce(F.sum(F.when(F.col("known"), rows)), F.lit(0)).alias("ratingsWithMovieData"),
            F.coalesce(F.sum(F.when(F.col("known").isNull(), rows)), F.lit(0)).alias("orphanedRatings"),
        )
        .withColumn(
            "orphanedPercentage",
            percent("orphanedRatings", F.col("ratingsWithMovieData") + F.col("orphanedRatings")),
        )
    )


def dq_orphan_tags(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Tags with and without a rating by the same user on the same movie."""
    rated = pairs.select("movieId", "userId").withColumn("rated", F.lit(True))
    used = tags.groupBy("movieId", "userId").agg(F.count("*").alias("uses"))
    return orphan_tags_of(used.join(rated, ["movieId", "userId"], "left"))


def orphan_tags_of(tagged: DataFrame) -> DataFrame:
    """The same, of folded tags (uses, rated) that have met the ratings already."""
    return (
        tagged.agg(
            F.coalesce(F.sum(F.when(F.col("rated"), F.col("uses"))), F.lit(0)).alias("tagsWithRatingData"),
            F.coalesce(F.sum(F.when(F.col("rated").isNull(), F.col("uses"))), F.lit(0)).alias("orphanedTags"),
        )
        .withColumn(
            "orphanedTagsPercentage",
            percent("orphanedTags", F.col("tagsWithRatingData") + F.col("orphanedTags")),
        )
    )


def dq_timestamps(seen: DataFrame) -> DataFrame:
    return seen.select("futureTimestamps", "invalidTimestamps")


def dq_consistency_score(seen: DataFrame) -> DataFrame:
    score = (
        F.lit(100.0)
        - F.when(_in_range(), 0.0).otherwise(20.0)
        - F.when(F.col("futureTimestamps") > 0, 10.0).otherwise(0.0)
        - F.when(F.col("invalidTimestamps") > 0, 10.0).otherwise(0.0)
    )
    return seen.select(score.alias("overallScore"))
