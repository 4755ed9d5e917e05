"""The analytics collectors: what each one measures, over shared base tables."""

from __future__ import annotations

import logging
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.fixed_values import NO_MOVIES_NOTE
from rateframe.functions.expressions import key_part
from rateframe.operators import content, distribution, facts, platform, quality, tags as tag_ops, temporal, users
from rateframe.operators.metrics import constant_metrics, metric_rows, plain_entries
from rateframe.session import hold, materialize

log = logging.getLogger(__name__)

TABLES_AT_ONCE = 4


@dataclass(frozen=True, eq=False)
class Inputs:
    """Clean ratings with optional movies and tags, and the base tables derived from them."""

    ratings: DataFrame
    movies: DataFrame | None
    tags: DataFrame | None
    as_of: int
    stored: bool = False

    def _base(self, df: DataFrame, label: str) -> DataFrame:
        return materialize(df, label) if self.stored else df

    def _row(self, df: DataFrame, rows: int = 1) -> DataFrame:
        return hold(df, rows) if self.stored else df

    @cached_property
    def seen(self) -> DataFrame:
        return self._row(quality.overview(self.ratings, self.as_of))

    @cached_property
    def histogram(self) -> DataFrame:
        return self._base(distribution.rating_histogram(self.ratings), "histogram")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._base(facts.pair_facts(self.ratings), "pairs")

    @cached_property
    def profile(self) -> DataFrame:
        if not self.stored:
            return users.user_profile_of_ratings(self.ratings)
        return self._base(users.user_profile(self.pairs), "profile")

    @cached_property
    def users_seen(self) -> DataFrame:
        return self._row(users.profile_overview(self.profile))

    @cached_property
    def segments(self) -> DataFrame:
        return self._row(users.segment_cube(self.profile), rows=972)

    @cached_property
    def movie_facts(self) -> DataFrame:
        if not self.stored:
            return facts.direct_facts(self.ratings, "movieId", "userId", "raters")
        return self._base(content.movie_facts(self.pairs), "movie-facts")

    @cached_property
    def performance(self) -> DataFrame:
        return content.movie_performance(self.movie_facts)

    @cached_property
    def movies_seen(self) -> DataFrame:
        return self._row(content.performance_overview(self.performance))

    @cached_property
    def tag_counts(self) -> DataFrame:
        return self._base(tag_ops.tag_counts(self.tags), "tag-counts")

    @cached_property
    def tagged(self) -> DataFrame:
        return self._base(tag_ops.tagged_pairs(self.tags, self.pairs), "tagged")

    @cached_property
    def popularity(self) -> DataFrame:
        if self.movies is None:
            return self.performance.select(
                "movieId",
                F.lit(None).cast("string").alias("title"),
                F.lit(None).cast("string").alias("genres"),
                F.col("totalRatings").alias("ratingsCount"),
                "avgRating",
                "ratingStdDev",
            )
        return content.movie_popularity(self.performance, self.movies)

    @cached_property
    def recent(self) -> DataFrame:
        if not self.stored:
            return quality.freshness_recent(quality.recency(self.ratings))
        return self._row(quality.freshness_recent(quality.recency_after(self.ratings, self.seen)))

    @cached_property
    def calendar(self) -> DataFrame:
        return temporal.calendar_features(self.ratings)

    @cached_property
    def cube(self) -> DataFrame:
        return self._row(temporal.calendar_cube(self.calendar), rows=2016)

    @cached_property
    def genres(self) -> DataFrame:
        if not self.stored:
            return content.genre_stats(facts.single_facts(self.ratings), self.movies)
        return self._base(content.genre_stats_of_facts(self.pairs, self.movie_facts, self.movies), "genres")

    @cached_property
    def top(self) -> DataFrame:
        return self._row(content.top_movies(self.popularity), rows=10)

    def prepare(self) -> None:
        """Compute the base tables once, before several collectors ask for them at the same time.

        Tables of one wave need only those of earlier waves, so a wave fills the cores that one table leaves idle.
        A base that cannot be computed fails again, and is reported, in the collectors that need it.
        """
        if not self.stored:
            return
        waves = [
            ["pairs", "seen", "histogram", "cube"],
            ["movie_facts", "profile", "recent"],
            ["users_seen", "segments", "movies_seen", "top"],
        ]
        if self.tags is not None:
            waves[0].append("tag_counts")
            waves[1].insert(0, "tagged")
        if self.movies is not None:
            waves[2].insert(0, "genres")

        def compute(name: str) -> None:
            try:
                getattr(self, name)
            except Exception:
                log.exception("base table %s failed", name)

        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            for wave in waves:
                list(pool.map(compute, wave))

    def store(self) -> "Inputs":
        """Read the sources once, keep them as tables, and keep every base table as well."""
        sources = {"ratings": self.ratings, "movies": self.movies, "tags": self.tags}
        with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
            kept = {name: pool.submit(materialize, df, name) for name, df in sources.items() if df is not None}
            return replace(self, **{name: table.result() for name, table in kept.items()}, stored=True)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _whole(df: DataFrame, collector: str, doc_type: str, prefix: str = "") -> DataFrame:
    return metric_rows(df, collector, doc_type, plain_entries(df, prefix))


def data_quality(data: Inputs) -> DataFrame:
    name = "DATA_QUALITY"
    recent = data.recent.select("recentRatings30Days", "recentActivityPercentage")
    parts = [
        _whole(quality.dq_completeness(data.seen), name, name, "completeness_"),
        _whole(quality.dq_duplicates(data.ratings), name, name, "completeness_"),
        _whole(quality.freshness_span(data.seen), name, name, "freshness_"),
        _whole(recent, name, name, "freshness_"),
        _whole(quality.dq_rating_range(data.histogram), name, name, "consistency_"),
        _whole(quality.dq_timestamps(data.seen), name, name, "consistency_"),
        _whole(quality.dq_consistency_score(data.seen), name, name, "consistency_"),
    ]
    if data.movies is not None:
        parts.append(_whole(quality.dq_orphan_ratings(data.movie_facts, data.movies), name, name, "consistency_"))
    if data.tags is not None:
        parts.append(_whole(quality.orphan_tags_of(data.tagged), name, name, "consistency_"))
    return union_all(parts)


def data_freshness(data: Inputs) -> DataFrame:
    name = "DATA_FRESHNESS"
    trend = quality.freshness_trend(data.recent).select("activityTrend")
    return union_all([
        _whole(quality.freshness_span(data.seen), name, name),
        _whole(data.recent, name, name),
        _whole(quality.freshness_score(data.seen, data.as_of), name, name),
        _whole(trend, name, name),
    ])


def rating_distribution(data: Inputs) -> DataFrame:
    name = "RATING_DISTRIBUTION"
    key = "concat('rating_', cast(ratingActual as string))"
    return union_all([
        metric_rows(data.histogram, name, name, [(key, "ratingCount")]),
        _whole(distribution.rating_stats(data.seen), name, name),
        _whole(distribution.rating_bands(data.seen), name, name),
        _whole(distribution.rating_mode(data.histogram), name, name),
        _whole(distribution.rating_quartiles(data.histogram), name, name),
    ])


def _segments(data: Inputs, collector: str) -> DataFrame:
    key = "concat_ws('_', 'segment', activityLevel, ratingPattern)"
    return metric_rows(users.segment_matrix(data.segments), collector, collector, [(key, "users")])


def user_activity(data: Inputs) -> DataFrame:
    name = "USER_ACTIVITY"
    top = users.top_users(data.profile)
    top_key = "concat('topUser_', userId, '_ratingsCount')"
    tiers = users.engagement_tiers(data.users_seen).select(
        "highlyEngagedUsers", "moderatelyEngagedUsers", "lowEngagedUsers"
    )
    levels = users.activity_levels(data.users_seen).select(
        "totalUsers", "highActivityUsers", "mediumActivityUsers", "lowActivityUsers", "highActivityPercentage"
    )
    return union_all([
        _whole(users.user_activity_summary(data.users_seen), name, name),
        metric_rows(top, name, name, [(top_key, "ratingsCount")]),
        _whole(users.user_engagement_summary(data.users_seen), name, name, "engagement_"),
        _whole(tiers, name, name),
        _segments(data, name),
        _whole(levels, name, name, "segmentation_"),
    ])


def user_segmentation(data: Inputs) -> DataFrame:
    name = "USER_SEGMENTATION"
    levels = users.activity_levels(data.users_seen)
    advanced = users.advanced_segments(data.segments)
    advanced_key = "concat_ws('_', 'advancedSegment', engagementLevel, ratingConsistency)"
    return union_all([
        _whole(levels, name, name),
        _segments(data, name),
        metric_rows(advanced, name, name, [(advanced_key, "users")]),
        _whole(users.segment_variation(data.users_seen), name, name),
        _whole(users.segmentation_score(data.users_seen), name, name),
    ])


def user_engagement(data: Inputs) -> DataFrame:
    name = "USER_ENGAGEMENT"
    behavior = users.rating_behavior_matrix(data.segments)
    key = "concat_ws('_', 'behavior', ratingFrequency, ratingDiversity)"
    return union_all([
        _whole(users.user_engagement_summary(data.users_seen), name, name),
        _whole(users.engagement_tiers(data.users_seen), name, name),
        metric_rows(behavior, name, name, [(key, "users")]),
        _whole(users.engagement_quality(data.users_seen), name, name),
        _whole(users.engagement_consistency(data.users_seen), name, name),
    ])


def _by_part(df: DataFrame, stem: str, part: str, values: list[str], names: list[str]) -> DataFrame:
    name = "TEMPORAL_TRENDS"
    keys = [(f"concat('{stem}_', {part}, '_{suffix}')", value) for value, suffix in zip(values, names)]
    return metric_rows(df, name, name, keys)


def temporal_trends(data: Inputs) -> DataFrame:
    two, two_names = ["ratingCount", "avgRating"], ["count", "avgRating"]
    return union_all([
        _by_part(temporal.yearly_trends(data.calendar), "year", "year",
                 [*two, "activeUsers"], [*two_names, "activeUsers"]),
        _by_part(temporal.monthly_trends(data.cube), "month", "month", two, two_names),
        _by_part(temporal.weekday_trends(data.cube), "dayOfWeek", "dayOfWeek", two, two_names),
        _by_part(temporal.top_hours(data.cube), "topHour", "hour", two, two_names),
    ])


def movie_popularity(data: Inputs) -> DataFrame:
    name, kind = "CONTENT_ANALYTICS", "MOVIE_POPULARITY"
    summary = content.movie_popularity_summary(data.movies_seen)
    key = lambda suffix: f"concat('topMovie_', movieId, '{suffix}')"
    titled = data.top.filter(F.col("title").isNotNull())
    parts = [
        _whole(summary, name, kind, "popularity_"),
        metric_rows(data.top, name, kind, [(key("_ratingsCount"), "ratingsCount")]),
        metric_rows(titled, name, kind, [
            (key("_title"), "title"), (key("_genres"), "genres"), (key("_avgRating"), "avgRating"),
        ]),
    ]
    if data.tags is not None:
        used = content.top_movie_tags(data.top, data.tags)
        tag_key = lambda suffix: f"concat('topMovie_', movieId, '_tag', rank, '{suffix}')"
        parts.append(metric_rows(used, name, kind, [(tag_key("_name"), "tag"), (tag_key("_count"), "tagCount")]))
        parts.append(constant_metrics(data.ratings.sparkSession, name, kind, {"tagAnalysisAvailable": True}))
    return union_all(parts)


def genre_distribution(data: Inputs) -> DataFrame:
    name, kind = "CONTENT_ANALYTICS", "GENRE_DISTRIBUTION"
    spark = data.ratings.sparkSession
    if data.movies is None:
        note = {"genreDataAvailable": False, "note": NO_MOVIES_NOTE}
        return union_all([
            constant_metrics(spark, name, kind, note),
            _whole(content.genre_fallback(data.movies_seen), name, kind),
        ])
    stats = data.genres.withColumn("ratingStdDev", F.coalesce("ratingStdDev", F.lit(0.0)))
    # A genre whose name has no letter or digit has no key of its own and is left out.
    safe_genre = key_part("genre", "", "")
    keyed = stats.filter(f"{safe_genre} <> ''")
    key = lambda suffix: f"concat('genre_', {safe_genre}, '_{suffix}')"
    return union_all([
        metric_rows(
            keyed, name, kind,
            [
                (key("name"), "genre"), (key("count"), "ratingCount"), (key("avgRating"), "avgRating"),
                (key("uniqueUsers"), "uniqueUsers"), (key("uniqueMovies"), "uniqueMovies"),
                (key("ratingStdDev"), "ratingStdDev"),
            ],
            label="genre", seq="-ratingCount",
        ),
        _whole(content.genre_extremes(stats), name, kind),
        constant_metrics(spark, name, kind, {"genreDataAvailable": True}),
    ])


def content_performance(data: Inputs) -> DataFrame:
    name, kind = "CONTENT_ANALYTICS", "CONTENT_PERFORMANCE"
    return union_all([
        _whole(content.content_performance_summary(data.movies_seen), name, kind, "performance_"),
        _whole(content.content_performance_flags(data.movies_seen), name, kind, "performance_"),
    ])


def content_analytics(data: Inputs) -> DataFrame:
    return union_all([movie_popularity(data), genre_distribution(data), content_performance(data)])


def tag_analytics(data: Inputs) -> DataFrame:
    name, kind = "TAG_ANALYTICS", "USER_ENGAGEMENT"
    spark = data.ratings.sparkSession
    popular = tag_ops.popular_tags(data.tags, data.tag_counts)
    liked = tag_ops.affinity_of(data.tagged.filter("rated"))
    safe_tag = key_part("tag", "nulltag", "emptyTag")
    popular_key = lambda suffix: f"concat('popularTag_', {safe_tag}, '_{suffix}')"
    liked_key = lambda suffix: f"concat('highRatedTag_', {safe_tag}, '_{suffix}')"
    liked_rows = metric_rows(
        liked, name, kind,
        [(liked_key("name"), "tag"), (liked_key("avgRating"), "avgRating"), (liked_key("ratingCount"), "ratingCount")],
        label="tag", seq="-avgRating",
    )
    any_liked = liked.agg((F.count("*") > 0).alias("tagRatingCorrelationAvailable"))
    parts = [
        _whole(tag_ops.tag_totals(data.tags), name, kind),
        metric_rows(
            popular, name, kind,
            [
                (popular_key("name"), "tag"), (popular_key("count"), "tagCount"),
                (popular_key("moviesTagged"), "moviesTagged"), (popular_key("usersWhoTagged"), "usersWhoTagged"),
            ],
            label="tag", seq="-tagCount",
        ),
        _whole(tag_ops.tag_sentiment(data.tag_counts), name, kind),
        liked_rows,
        _whole(any_liked, name, kind),
        constant_metrics(
            spark, name, kind,
            {"tagDataAvailable": True, "genreTagAnalysisAvailable": data.movies is not None},
        ),
    ]
    if data.movies is not None:
        used = tag_ops.genre_top_tags(data.tags, data.movies)
        safe_genre = key_part("genre", "nullgenre", "emptyGenre")
        genre_key = lambda suffix: f"concat('genre_', {safe_genre}, '_topTag', rank, '_{suffix}')"
        parts.append(metric_rows(
            used, name, kind, [(genre_key("name"), "tag"), (genre_key("count"), "tagCount")],
            label="genre", seq="rank",
        ))
    return union_all(parts)


def system_performance(data: Inputs, run_dependent: bool = True) -> DataFrame:
    """``run_dependent=False`` leaves out what differs from run to run: timing and partitions."""
    name, kind = "SYSTEM_PERFORMANCE", "PROCESSING_PERFORMANCE"
    nothing = data.ratings.sparkSession.createDataFrame([], "n int")
    sizes = platform.dataset_sizes(
        data.ratings,
        nothing if data.movies is None else data.movies,
        nothing if data.tags is None else data.tags,
    )
    parts = [
        _whole(platform.null_records(data.seen), name, kind),
        _whole(sizes, name, kind),
        _whole(platform.user_skew(data.profile), name, kind),
        _whole(platform.valid_row_ratio(data.seen), name, kind),
    ]
    if run_dependent:
        timing = platform.run_timing(data.ratings)
        layout = platform.partition_profile(data.ratings).select(
            "partitionCount",
            F.col("partitionCount").alias("ratingsPartitions"),
            F.floor("avgRecordsPerPartition").alias("recordsPerPartition"),
            "avgRecordsPerPartition",
            "isWellPartitioned",
            "estimatedMemoryUsageBytes",
        )
        parts += [
            _whole(timing.drop("totalRecords"), name, kind),
            _whole(layout, name, kind),
        ]
    return union_all(parts)


RATING_COLUMNS = ("userId", "movieId", "ratingActual", "timestampEpochSeconds")


@dataclass(frozen=True)
class Collector:
    name: str
    collect: Callable[[Inputs], DataFrame]
    rating_columns: tuple[str, ...] = ()
    needs_tags: bool = False

    def can_process(self, data: Inputs) -> bool:
        has_columns = set(self.rating_columns) <= set(data.ratings.columns)
        has_tags = data.tags is not None and not data.tags.isEmpty()
        return has_columns and (has_tags or not self.needs_tags) and not data.ratings.isEmpty()


# In the order they run.
COLLECTORS = (
    Collector("DATA_QUALITY", data_quality),
    Collector("USER_ACTIVITY", user_activity, RATING_COLUMNS),
    Collector("DATA_FRESHNESS", data_freshness),
    Collector("CONTENT_ANALYTICS", content_analytics),
    Collector("USER_ENGAGEMENT", user_engagement, RATING_COLUMNS),
    Collector("RATING_DISTRIBUTION", rating_distribution),
    Collector("USER_SEGMENTATION", user_segmentation, RATING_COLUMNS[:3]),
    Collector("TEMPORAL_TRENDS", temporal_trends, ("timestampEpochSeconds",)),
    Collector("TAG_ANALYTICS", tag_analytics, needs_tags=True),
    Collector("SYSTEM_PERFORMANCE", system_performance),
)


def select_collectors(*names: str) -> tuple[Collector, ...]:
    """Collectors by name, in any case; names nobody knows are left out."""
    wanted = {n.upper() for n in names}
    return tuple(c for c in COLLECTORS if c.name in wanted)
