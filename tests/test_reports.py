"""Edge cases of the analytics reports: bounds, ties, empty tables, nulls."""

import pytest
from pyspark.sql import functions as F

from rateframe.operators import content, distribution, platform, quality, tags as tag_ops, temporal, users
from rateframe.operators.facts import pair_facts

RATINGS = "userId int, movieId int, ratingActual double, timestampEpochSeconds bigint"
DAY = 86400


def ratings(spark, rows):
    return spark.createDataFrame(rows, RATINGS)


def one(df):
    found = df.collect()
    assert len(found) == 1
    return found[0].asDict()


def profile(spark, rows):
    return users.user_profile(pair_facts(ratings(spark, rows)))


def by_count(spark, counts):
    """Users with the given numbers of ratings, all on different movies."""
    return profile(spark, [(u, m, 3.0, m) for u, n in enumerate(counts, 1) for m in range(1, n + 1)])


def test_single_rating_has_no_deviation(spark):
    row = one(profile(spark, [(1, 1, 4.0, 5)]))
    assert row["ratingStdDev"] is None and row["engagementSpan"] == 0
    over = users.profile_overview(profile(spark, [(1, 1, 4.0, 5)]))
    assert one(users.user_engagement_summary(over))["avgRatingStdDev"] == 0.0
    assert one(users.segment_variation(over))["activityVariation"] == 0.0
    assert one(users.engagement_consistency(over))["engagementConsistencyScore"] == 100.0
    segments = one(users.advanced_segments(users.segment_cube(profile(spark, [(1, 1, 4.0, 5)]))))
    assert segments["ratingConsistency"] == "Variable"


def test_profile_agrees_with_plain_aggregates(spark):
    rows = [(i % 7, i % 11, (i % 10 + 1) / 2, i * 1000) for i in range(500)] + [(1, 1, 2.5, 7)] * 300
    df = ratings(spark, rows)
    plain = df.groupBy("userId").agg(
        F.count("*").alias("n"), F.avg("ratingActual").alias("a"), F.stddev_samp("ratingActual").alias("s"),
        F.count_distinct("movieId").alias("d"),
    )
    for r in users.user_profile(pair_facts(df)).join(plain, "userId").collect():
        assert (r.totalRatings, r.uniqueMovies) == (r.n, r.d)
        assert r.avgRating == pytest.approx(r.a) and r.ratingStdDev == pytest.approx(r.s)


def test_equal_ratings_have_deviation_zero(spark):
    assert one(profile(spark, [(1, m, 3.5, m) for m in range(1, 50)]))["ratingStdDev"] == 0.0


def test_tier_and_level_bounds(spark):
    over = users.profile_overview(by_count(spark, [9, 10, 50, 51]))
    row = one(users.engagement_tiers(over))
    assert [row[c] for c in ("lowEngagedUsers", "moderatelyEngagedUsers", "highlyEngagedUsers")] == [1, 2, 1]
    levels = one(users.activity_levels(users.profile_overview(by_count(spark, [20, 21, 100, 101]))))
    assert [levels[f"{x}ActivityUsers"] for x in ("low", "medium", "high")] == [1, 2, 1]


def test_pattern_bounds(spark):
    p = profile(spark, [(1, 1, 2.5, 1), (2, 1, 3.0, 1), (3, 1, 4.0, 1), (4, 1, 4.5, 1)])
    levels = one(users.activity_levels(users.profile_overview(p)))
    assert [levels[f"{x}Users"] for x in ("critical", "neutral", "positive")] == [1, 2, 1]


def test_diversity_bounds_are_exclusive(spark):
    half = [(1, m, 3.0, 1) for m in (1, 1)]
    four_fifths = [(2, m, 3.0, 1) for m in (1, 2, 3, 4, 4)]
    got = {
        (r.ratingDiversity, r.users)
        for r in users.rating_behavior_matrix(users.segment_cube(profile(spark, half + four_fifths))).collect()
    }
    assert got == {("LowDiversity", 1), ("ModerateDiversity", 1)}


def test_segmentation_score_steps(spark):
    def score(high, low):
        over = spark.createDataFrame([(high, 0, low, high + low)], "high bigint, medium bigint, low bigint, users bigint")
        return one(users.segmentation_score(over))["segmentationEffectivenessScore"]

    assert [score(81, 19), score(80, 20), score(70, 30), score(60, 40)] == [70.0, 80.0, 90.0, 100.0]


def test_no_users(spark):
    over = users.profile_overview(profile(spark, []))
    assert one(users.activity_levels(over))["highActivityPercentage"] == 0.0
    assert one(users.segmentation_score(over)) == {"maxSegmentPercentage": 0.0, "segmentationEffectivenessScore": 100.0}


def test_top_users_break_ties_by_id(spark):
    got = [r.userId for r in users.top_users(by_count(spark, [2] * 12)).collect()]
    assert got == list(range(1, 11))


def test_band_bounds(spark):
    df = ratings(spark, [(1, i, r, 1) for i, r in enumerate((0.5, 2.4, 2.5, 3.9, 3.95, 4.0, 5.0))])
    row = one(distribution.rating_bands(quality.overview(df, 0)))
    assert (row["lowRatings"], row["mediumRatings"], row["highRatings"]) == (2, 2, 2)


def test_mode_ties_go_to_the_lower_rating(spark):
    h = distribution.rating_histogram(ratings(spark, [(1, 1, r, 1) for r in (2.0, 2.0, 4.0, 4.0, 1.0, 5.0)]))
    row = one(distribution.rating_mode(h))
    assert (row["mostCommonRating"], row["leastCommonRating"]) == (2.0, 1.0)


def test_quartiles_from_histogram_equal_quartiles_of_rows(spark):
    df = ratings(spark, [(1, i, (i * 7 % 10 + 1) / 2, 1) for i in range(33)])
    row = one(distribution.rating_quartiles(distribution.rating_histogram(df)))
    q1, q2, q3 = df.agg(F.percentile("ratingActual", [0.25, 0.5, 0.75])).first()[0]
    assert (row["ratingQ1"], row["ratingMedian"], row["ratingQ3"]) == (q1, q2, q3)


@pytest.mark.parametrize("days, score", [(7, 100), (8, 95), (30, 95), (31, 85), (90, 85), (91, 70), (365, 70), (366, 50)])
def test_freshness_score_steps(spark, days, score):
    seen = quality.overview(ratings(spark, [(1, 1, 3.0, 1000)]), 0)
    assert one(quality.freshness_score(seen, 1000 + days * DAY))["freshnessScore"] == score


def test_recent_bounds_are_strict(spark):
    newest = 100 * DAY
    ages = [0, DAY - 1, DAY, 7 * DAY - 1, 7 * DAY, 30 * DAY - 1, 30 * DAY, 60 * DAY]
    df = ratings(spark, [(1, i, 3.0, newest - a) for i, a in enumerate(ages)])
    row = one(quality.freshness_recent(quality.recency(df.repartition(4))))
    assert (row["ratingsLast24Hours"], row["ratingsLast7Days"], row["recentRatings30Days"]) == (2, 4, 6)


def test_recency_without_times_and_with_copies(spark):
    empty = one(quality.recency(ratings(spark, [])))
    assert (empty["newest"], empty["timestamps"], empty["recentRatings30Days"]) == (None, 0, 0)
    df = ratings(spark, [(1, 1, 3.0, None), *[(1, i, 3.0, 10) for i in range(50)], *[(2, i, 3.0, 10 - 40 * DAY) for i in range(9)]])
    row = one(quality.recency(df.repartition(5)))
    assert (row["oldest"], row["newest"], row["timestamps"], row["ratingsLast24Hours"], row["recentRatings30Days"]) == (10 - 40 * DAY, 10, 59, 50, 50)


@pytest.mark.parametrize("day, week, label", [(2, 7, "Increasing"), (1, 7, "Stable"), (0, 7, "Decreasing"), (1, 14, "Stable")])
def test_trend(spark, day, week, label):
    recent = spark.createDataFrame([(day, week)], "ratingsLast24Hours bigint, ratingsLast7Days bigint")
    assert one(quality.freshness_trend(recent))["activityTrend"] == label


def test_span_of_one_moment_counts_as_a_day(spark):
    df = ratings(spark, [(1, 1, 3.0, 50), (2, 1, 3.0, 50)])
    row = one(quality.freshness_span(quality.overview(df, 0)))
    assert (row["timeSpanDays"], row["ratingsPerDay"]) == (0, 2.0)


def test_consistency_score_and_timestamps(spark):
    seen = quality.overview(ratings(spark, [(1, 1, 5.5, -1), (1, 1, 3.0, 99)]), 50)
    assert one(quality.dq_consistency_score(seen))["overallScore"] == 60.0
    assert one(quality.dq_timestamps(seen)) == {"futureTimestamps": 1, "invalidTimestamps": 1}


def test_orphans_do_not_multiply(spark):
    df = ratings(spark, [(1, 1, 3.0, 1), (1, 1, 3.0, 1), (1, 2, 3.0, 1)])
    pairs = pair_facts(df)
    twice = spark.createDataFrame([(1,), (1,)], "movieId int")
    row = one(quality.dq_orphan_ratings(content.movie_facts(pairs), twice))
    assert (row["ratingsWithMovieData"], row["orphanedRatings"]) == (2, 1)
    tags = spark.createDataFrame([(1, 1, "a"), (1, 9, "b")], "userId int, movieId int, tag string")
    row = one(quality.dq_orphan_tags(tags, pairs))
    assert (row["tagsWithRatingData"], row["orphanedTags"]) == (1, 1)


def test_empty_ratings(spark):
    df = ratings(spark, [])
    seen = quality.overview(df, 0)
    assert one(quality.dq_completeness(seen))["userIdCompleteness"] is None
    assert one(quality.dq_duplicates(df))["uniqueRecords"] == 0
    assert one(platform.valid_row_ratio(seen))["validRowsCount"] == 0


def test_calendar_is_utc_and_sunday_is_day_one(spark):
    row = one(temporal.calendar_features(ratings(spark, [(1, 1, 3.0, 0)])))
    assert (row["date"], row["dayOfWeek"], row["hour"]) == ("1970-01-01 00:00:00", 5, 0)


MOVIES = "movieId int, title string, genres string"
TAGS = "userId int, movieId int, tag string"


def test_genres_with_blanks_repeats_and_the_sentinel(spark):
    pairs = pair_facts(ratings(spark, [(1, 1, 4.0, 1), (2, 1, 2.0, 1), (1, 2, 5.0, 1), (1, 3, 5.0, 1)]))
    movies = spark.createDataFrame([(1, "a", "A||B|A"), (2, "b", "A"), (3, "c", "(no genres listed)")], MOVIES)
    got = {r.genre: r for r in content.genre_stats(pairs, movies).collect()}
    assert set(got) == {"A", "B"}
    assert (got["A"].ratingCount, got["A"].uniqueUsers, got["A"].uniqueMovies) == (5, 2, 2)
    assert (got["B"].ratingCount, got["B"].uniqueUsers, got["B"].uniqueMovies) == (2, 2, 1)


def test_genre_extremes_break_ties_by_name(spark):
    stats = spark.createDataFrame([("B", 5, 3.0), ("A", 5, 3.0)], "genre string, ratingCount bigint, avgRating double")
    row = one(content.genre_extremes(stats))
    assert {row[c] for c in ("mostPopularGenre", "leastPopularGenre", "bestRatedGenre", "worstRatedGenre")} == {"A"}
    assert (row["mostPopularGenreCount"], row["bestRatedGenreAvg"]) == (5, 3.0)


def test_top_movies_without_metadata(spark):
    facts = content.movie_facts(pair_facts(ratings(spark, [(1, 7, 4.0, 1)])))
    movies = spark.createDataFrame([], MOVIES)
    row = one(content.top_movies(content.movie_popularity(content.movie_performance(facts), movies)))
    assert (row["title"], row["genres"], row["ratingsCount"]) == (None, "(no genres listed)", 1)


@pytest.mark.parametrize("tags, positive, negative, ratio", [
    (["GOOD but bad", "great"], 2, 1, 2.0), (["perfect"], 1, 0, float("inf")), (["plain", None], 0, 0, 0.0), ([], 0, 0, 0.0),
])
def test_sentiment(spark, tags, positive, negative, ratio):
    df = spark.createDataFrame([(t,) for t in tags], "tag string")
    row = one(tag_ops.tag_sentiment(tag_ops.tag_counts(df)))
    assert (row["positiveTags"], row["negativeTags"], row["sentimentRatio"]) == (positive, negative, ratio)


def test_affinity_counts_every_match_and_needs_more_than_five(spark):
    rated = ratings(spark, [(1, 1, 4.0, 1), (1, 1, 2.0, 2), (1, 2, 5.0, 1)])
    tags = spark.createDataFrame([(1, 1, "x")] * 3 + [(1, 2, "y")] * 5, TAGS)
    got = [tuple(r) for r in tag_ops.tag_rating_affinity(tags, pair_facts(rated)).collect()]
    assert got == [("x", 3.0, 6)]


def test_user_skew_flag(spark):
    row = one(platform.user_skew(by_count(spark, [1, 101])))
    assert row["userDataSkewRatio"] == 101.0 and row["hasSignificantSkew"]


def test_partition_profile_covers_all_rows(spark):
    row = one(platform.partition_profile(spark.range(5000).repartition(4)))
    assert (row["totalRecords"], row["partitionCount"], row["isWellPartitioned"]) == (5000, 4, True)


def test_run_timing_counts_rows(spark):
    row = one(platform.run_timing(spark.range(100)))
    assert row["totalRecords"] == 100 and 0 <= row["processingEfficiencyScore"] <= 100
