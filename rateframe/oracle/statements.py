"""One DuckDB statement per query whose result SQL can state."""

from __future__ import annotations

from rateframe.oracle.metrics import METRICS_SQL
from rateframe.oracle.views import with_views

QUALITY_AS_OF = 1001894400
FRESHNESS_AS_OF = 1011052800
GENERATED_AT = 1700000000000000

TITLED = """
    left join (select movieId, title,
                      array_to_string(list_filter(string_split(genres, '|'),
                          lambda g: g <> '(no genres listed)' and g <> ''), ';') as genreNames
               from movies) m using (movieId)"""


def rec_rows(users: str = "true", at: int = GENERATED_AT, top: int = 10) -> str:
    return f"""
        select r.userId, cast({at} as bigint) as generatedAt, 'v1' as modelVersion,
               cast(least({top}, (select count(*) from recs c where c.userId = r.userId)) as int) as totalRecommendations,
               cast(r.rk as int) as position, movieId, round(r.rating, 6) as rating, m.title, m.genreNames
        from recs r {TITLED} where r.rk <= {top} and {users}"""


def best_ten(condition: str, at: int, version: str) -> str:
    return f"""
        select userId, cast({at} as bigint) as generatedAt, '{version}' as modelVersion, movieId, rating, rk from (
            select userId, movieId, rating,
                   row_number() over (partition by userId order by rating desc, movieId) as rk
            from (select userId, movieId, avg(ratingActual) as rating from ratings
                  where {condition} group by userId, movieId) a) b where rk <= 10"""


DOC_COLUMNS = "analyticsId, generatedAtMicros, type, description"
# case, filter, order, page, size
DOC_CASES = (
    ("id", "analyticsId = 'doc_10'", "generatedAtMicros desc", 0, 20),
    ("types_and_dates",
     "type in ('DATA_QUALITY', 'USER_ACTIVITY') and generatedAtMicros > 1704153600000000 "
     "and generatedAtMicros < 1706745600000000", "analyticsId", 1, 10),
    ("types", "type in ('MOVIE_POPULARITY', 'MYSTERY_TYPE')", "generatedAtMicros desc", 2, 20),
    ("since", "generatedAtMicros > 1705000000000000", "generatedAtMicros", 0, 7),
    ("until", "generatedAtMicros > 0 and generatedAtMicros < 1705000000000000", "generatedAtMicros desc", 0, 20),
    ("keyword", "contains(lower(description), 'purchase by user 1')", "description desc", 0, 15),
    ("all", "true", "generatedAtMicros desc", 0, 100),
    ("beyond_last_page", "true", "generatedAtMicros desc", 1000000, 20),
)

LATEST_VERSIONS = """
    select * from (
        select concat(type, '|', description) as analyticsId, generatedAtMicros, type, description,
               round(metricValue, 6) as metricValue,
               row_number() over (partition by type, description
                   order by generatedAtMicros desc) as newest
        from analytics_docs) d where newest = 1"""

_PLAIN: dict[str, str] = {
    # --- ingest and cleaning
    "ingest_ratings": "select * from raw_ratings",
    "ingest_movies": "select movieId, title, genres from movies",
    "ingest_tags": "select * from tags",
    "conform_columns": "select * from raw_ratings",
    "clean_ratings": "select * from ratings",
    "quarantine_ratings": """
        select r.userId, r.movieId, r.rating, r."timestamp",
               case when userId is null then 'MISSING_VALUE'
                    when try_cast(rating as double) is null then 'UNREADABLE_RATING'
                    else 'RATING_OUT_OF_RANGE' end as reason
        from raw_ratings r
        where userId is null or try_cast(rating as double) is null
           or not try_cast(rating as double) between 0.5 and 5.0""",
    "movie_genres_array": """
        select movieId, title, cast(len(g) as int) as genreCount, array_to_string(g, ';') as genreNames
        from (select movieId, title, list_filter(string_split(genres, '|'),
                     lambda x: x <> '(no genres listed)' and x <> '') as g from movies) m""",
    "movie_lookup_batch": f"""
        select movieId, m.title is not null as "exists", title, genreNames,
               (select count(*) from movies) as movieCount
        from (select distinct movieId from interactions where movieId is not null) i {TITLED}""",
    "prediction_pairs": "select userId, movieId from interactions where movieId is not null",
    # --- data quality and freshness
    "dq_completeness": """
        select n as totalRows, round(u, 6) as userIdCompleteness, round(m, 6) as movieIdCompleteness,
               round(r, 6) as ratingCompleteness, round(t, 6) as timestampCompleteness,
               round((u + m + r + t) / 4, 6) as overallCompleteness
        from (select count(*) as n, 100.0::double * count(userId) / count(*) as u,
                     100.0::double * count(movieId) / count(*) as m,
                     100.0::double * count(ratingActual) / count(*) as r,
                     100.0::double * count(timestampEpochSeconds) / count(*) as t from typed_raw) x""",
    "dq_duplicates": """
        select u as uniqueRecords, n - u as duplicateRecords, round(100.0::double * (n - u) / n, 6) as duplicatePercentage
        from (select (select count(*) from (select distinct * from typed_raw) d) as u,
                     (select count(*) from typed_raw) as n) x""",
    "dq_freshness": """
        select oldest as oldestRatingTimestamp, newest as newestRatingTimestamp,
               (newest - oldest) // 86400 as timeSpanDays,
               round(o.n / greatest((newest - oldest) // 86400, 1)::double, 6) as ratingsPerDay,
               round(o.n / greatest((newest - oldest) // 86400, 1)::double / 24, 6) as ratingsPerHour,
               r30 as recentRatings30Days, round(100.0::double * r30 / r.n, 6) as recentActivityPercentage
        from overview o cross join recent r""",
    "dq_rating_range": """
        select min(ratingActual) as minRating, max(ratingActual) as maxRating,
               count(distinct ratingActual) as uniqueRatingValues,
               min(ratingActual) >= 0.5 and max(ratingActual) <= 5.0 as ratingsInValidRange
        from typed_raw""",
    "dq_orphan_ratings": """
        select w as ratingsWithMovieData, n - w as orphanedRatings, round(100.0::double * (n - w) / n, 6) as orphanedPercentage
        from (select count(*) as n,
                     count(*) filter (where movieId in (select movieId from movies)) as w from ratings) x""",
    "dq_orphan_tags": """
        select w as tagsWithRatingData, n - w as orphanedTags, round(100.0::double * (n - w) / n, 6) as orphanedTagsPercentage
        from (select (select count(*) from tags) as n,
                     (select count(*) from tags t semi join ratings r
                        on r.movieId = t.movieId and r.userId = t.userId) as w) x""",
    "dq_timestamps": f"""
        select count(*) filter (where timestampEpochSeconds > {QUALITY_AS_OF}) as futureTimestamps,
               count(*) filter (where timestampEpochSeconds < 0) as invalidTimestamps from typed_raw""",
    "dq_consistency_score": f"""
        select 100.0::double - case when min(ratingActual) >= 0.5 and max(ratingActual) <= 5.0 then 0 else 20 end
               - case when max(timestampEpochSeconds) > {QUALITY_AS_OF} then 10 else 0 end
               - case when min(timestampEpochSeconds) < 0 then 10 else 0 end as overallScore
        from typed_raw""",
    "freshness_span": """
        select oldest as oldestRatingTimestamp, newest as newestRatingTimestamp,
               (newest - oldest) // 86400 as timeSpanDays,
               round(n / greatest((newest - oldest) // 86400, 1)::double, 6) as ratingsPerDay,
               round(n / greatest((newest - oldest) // 86400, 1)::double / 24, 6) as ratingsPerHour
        from overview""",
    "freshness_recent": """
        select r30 as recentRatings30Days, round(100.0::double * r30 / n, 6) as recentActivityPercentage,
               r7 as ratingsLast7Days, r1 as ratingsLast24Hours,
               round(100.0::double * r7 / n, 6) as weeklyActivityPercentage,
               round(100.0::double * r1 / n, 6) as dailyActivityPercentage
        from recent""",
    "freshness_score": f"""
        select a as dataAgeSeconds, a // 86400 as dataAgeDays,
               100.0::double - case when a // 86400 > 365 then 50 when a // 86400 > 90 then 30
                            when a // 86400 > 30 then 15 when a // 86400 > 7 then 5 else 0 end as freshnessScore
        from (select {FRESHNESS_AS_OF} - newest as a from overview) x""",
    "freshness_trend": """
        select r1 as ratingsLast24Hours, r7 as ratingsLast7Days,
               case when r1 > r7 / 7.0::double then 'Increasing' when r1 < r7 / 14.0::double then 'Decreasing'
                    else 'Stable' end as activityTrend
        from recent""",
    # --- rating distribution
    "rating_histogram": "select ratingActual, n as ratingCount from histogram",
    "rating_stats": """
        select count(ratingActual) as totalRatings, round(avg(ratingActual), 6) as avgRating,
               min(ratingActual) as minRating, max(ratingActual) as maxRating,
               round(stddev_samp(ratingActual), 6) as stdDevRating from ratings""",
    "rating_bands": """
        select h as highRatings, m as mediumRatings, l as lowRatings,
               round(100.0::double * h / n, 6) as highRatingsPercentage,
               round(100.0::double * m / n, 6) as mediumRatingsPercentage,
               round(100.0::double * l / n, 6) as lowRatingsPercentage
        from (select count(*) as n, count(*) filter (where ratingActual >= 4.0) as h,
                     count(*) filter (where ratingActual between 2.5 and 3.9) as m,
                     count(*) filter (where ratingActual < 2.5) as l from ratings) x""",
    "rating_mode": """
        select (select count(*) from histogram) as uniqueRatingValues,
               most.ratingActual as mostCommonRating, most.n as mostCommonRatingCount,
               least.ratingActual as leastCommonRating, least.n as leastCommonRatingCount
        from (select * from histogram order by n desc, ratingActual limit 1) most
        cross join (select * from histogram order by n, ratingActual limit 1) least""",
    "rating_quartiles": """
        select quantile_cont(ratingActual, 0.25) as ratingQ1, quantile_cont(ratingActual, 0.5) as ratingMedian,
               quantile_cont(ratingActual, 0.75) as ratingQ3,
               quantile_cont(ratingActual, 0.75) - quantile_cont(ratingActual, 0.25) as ratingIQR
        from ratings""",
    # --- users
    "user_profile": """
        select userId, totalRatings, round(avgRating, 6) as avgRating, round(sd, 6) as ratingStdDev,
               uniqueMovies, minTimestamp, maxTimestamp, engagementSpan
        from profile join (select userId, stddev_samp(ratingActual) as sd from ratings group by userId) s using (userId)""",
    "top_users": """
        select userId, totalRatings as ratingsCount from profile order by totalRatings desc, userId limit 10""",
    "user_activity_summary": """
        select count(*) as totalUsers, round(avg(totalRatings), 6) as avgRatingsPerUser,
               min(totalRatings) as minRatingsPerUser, max(totalRatings) as maxRatingsPerUser,
               quantile_disc(totalRatings, 0.5) as medianRatingsPerUser from profile""",
    "user_engagement_summary": """
        select round(avg(totalRatings), 6) as avgRatingsPerUser, round(avg(avgRating), 6) as avgUserRating,
               round(coalesce(avg(ratingStdDev), 0), 6) as avgRatingStdDev,
               round(avg(uniqueMovies), 6) as avgUniqueMoviesPerUser,
               round(avg(engagementSpan), 6) as avgEngagementSpanSeconds from profile""",
    "engagement_tiers": """
        select h as highlyEngagedUsers, m as moderatelyEngagedUsers, l as lowEngagedUsers, n as totalEngagedUsers,
               round(100.0::double * h / n, 6) as highEngagementPercentage,
               round(100.0::double * m / n, 6) as moderateEngagementPercentage,
               round(100.0::double * l / n, 6) as lowEngagementPercentage
        from (select count(*) as n, count(*) filter (where totalRatings > 50) as h,
                     count(*) filter (where totalRatings between 10 and 50) as m,
                     count(*) filter (where totalRatings < 10) as l from profile) x""",
    "activity_levels": """
        select n as totalUsers, h as highActivityUsers, m as mediumActivityUsers, l as lowActivityUsers,
               p as positiveUsers, u as neutralUsers, c as criticalUsers,
               round(100.0::double * h / n, 6) as highActivityPercentage,
               round(100.0::double * m / n, 6) as mediumActivityPercentage,
               round(100.0::double * l / n, 6) as lowActivityPercentage,
               round(100.0::double * p / n, 6) as positiveUsersPercentage,
               round(100.0::double * u / n, 6) as neutralUsersPercentage,
               round(100.0::double * c / n, 6) as criticalUsersPercentage
        from (select count(*) as n,
                     count(*) filter (where activityLevel = 'High') as h,
                     count(*) filter (where activityLevel = 'Medium') as m,
                     count(*) filter (where activityLevel = 'Low') as l,
                     count(*) filter (where ratingPattern = 'Positive') as p,
                     count(*) filter (where ratingPattern = 'Neutral') as u,
                     count(*) filter (where ratingPattern = 'Critical') as c from labels_of) x""",
    "segment_matrix": "select activityLevel, ratingPattern, count(*) as users from labels_of group by all",
    "advanced_segments": "select engagementLevel, ratingConsistency, count(*) as users from labels_of group by all",
    "rating_behavior_matrix": "select ratingFrequency, ratingDiversity, count(*) as users from labels_of group by all",
    "segment_variation": """
        select round(avg(totalRatings), 6) as avgRatingsAcrossUsers, round(avg(avgRating), 6) as avgRatingAcrossUsers,
               round(avg(uniqueMovies), 6) as avgUniqueMoviesAcrossUsers,
               round(coalesce(stddev_samp(totalRatings), 0), 6) as activityVariation,
               round(coalesce(stddev_samp(avgRating), 0), 6) as ratingVariation from profile""",
    "segmentation_score": """
        select round(s, 6) as maxSegmentPercentage,
               100.0::double - case when s > 80 then 30 when s > 70 then 20 when s > 60 then 10 else 0 end
                   as segmentationEffectivenessScore
        from (select max(n) * 100.0::double / sum(n) as s
              from (select count(*) as n from labels_of group by activityLevel) c) x""",
    "engagement_quality": """
        select quantile_disc(totalRatings, 0.5) as medianRatingsPerUser,
               quantile_disc(uniqueMovies, 0.5) as medianUniqueMoviesPerUser,
               max(totalRatings) as maxRatingsPerUser, max(uniqueMovies) as maxUniqueMoviesPerUser from profile""",
    "engagement_consistency": """
        select 100.0::double - case when s > 2.0 then 30 when s > 1.5 then 20 when s > 1.0 then 10 else 0 end
                   as engagementConsistencyScore
        from (select avg(ratingStdDev) as s from profile) x""",
    # --- temporal trends
    "calendar_features": """
        select userId, movieId, ratingActual, timestampEpochSeconds,
               strftime(moment, '%Y-%m-%d %H:%M:%S') as date, cast(year as int) as year, cast(month as int) as month,
               cast(dayOfWeek as int) as dayOfWeek, cast(hour as int) as hour from calendar""",
    "yearly_trends": """
        select cast(year as int) as year, count(*) as ratingCount, round(avg(ratingActual), 6) as avgRating,
               count(distinct userId) as activeUsers from calendar group by year""",
    "monthly_trends": """
        select cast(month as int) as month, count(*) as ratingCount, round(avg(ratingActual), 6) as avgRating
        from calendar group by month""",
    "weekday_trends": """
        select cast(dayOfWeek as int) as dayOfWeek, count(*) as ratingCount, round(avg(ratingActual), 6) as avgRating
        from calendar group by dayOfWeek""",
    "top_hours": """
        select cast(hour as int) as hour, count(*) as ratingCount, round(avg(ratingActual), 6) as avgRating
        from calendar group by hour order by count(*) desc, hour limit 5""",
    # --- content
    "movie_popularity": """
        select p.movieId, m.title, m.genres, totalRatings as ratingsCount, round(avgRating, 6) as avgRating,
               round(ratingStdDev, 6) as ratingStdDev
        from performance p left join movies m on m.movieId = p.movieId""",
    "movie_popularity_summary": """
        select count(*) as totalMovies, round(avg(totalRatings), 6) as avgRatingsPerMovie,
               min(totalRatings) as minRatingsPerMovie, max(totalRatings) as maxRatingsPerMovie,
               quantile_disc(totalRatings, 0.5) as medianRatingsPerMovie,
               round(avg(avgRating), 6) as overallAvgRating from performance""",
    "top_movies": "select movieId, title, genres, ratingsCount, round(avgRating, 6) as avgRating from top10",
    "top_movie_tags": "select movieId, tag, tagCount, cast(rank as int) as rank from top10_tags",
    "genre_stats": """
        select genre, ratingCount, round(avgRating, 6) as avgRating, uniqueUsers, uniqueMovies,
               round(ratingStdDev, 6) as ratingStdDev from genre_agg""",
    "genre_extremes": """
        select (select count(*) from genre_agg) as totalGenres,
               most.genre as mostPopularGenre, most.ratingCount as mostPopularGenreCount,
               few.genre as leastPopularGenre, few.ratingCount as leastPopularGenreCount,
               best.genre as bestRatedGenre, round(best.avgRating, 6) as bestRatedGenreAvg,
               worst.genre as worstRatedGenre, round(worst.avgRating, 6) as worstRatedGenreAvg
        from (select * from genre_agg order by ratingCount desc, genre limit 1) most
        cross join (select * from genre_agg order by ratingCount, genre limit 1) few
        cross join (select * from genre_agg order by avgRating desc, genre limit 1) best
        cross join (select * from genre_agg order by avgRating, genre limit 1) worst""",
    "genre_fallback": """
        select count(*) as totalMovies, round(avg(totalRatings), 6) as avgRatingsPerMovie,
               round(avg(avgRating), 6) as avgMovieRating from performance""",
    "movie_performance": """
        select movieId, totalRatings, round(avgRating, 6) as avgRating, round(ratingStdDev, 6) as ratingStdDev,
               uniqueRaters, minRating, maxRating from performance""",
    "content_performance_summary": """
        select count(*) as totalMovies, round(avg(totalRatings), 6) as avgRatingsPerMovie,
               round(avg(avgRating), 6) as overallAvgRating,
               round(coalesce(avg(ratingStdDev), 0), 6) as avgRatingVariability,
               round(avg(uniqueRaters), 6) as avgUniqueRatersPerMovie from performance""",
    "content_performance_flags": """
        select count(*) filter (where avgRating > 4.0) as highRatedMovies,
               count(*) filter (where avgRating < 2.5) as lowRatedMovies,
               count(*) filter (where ratingStdDev > 1.5) as polarizingMovies from performance""",
    # --- tags
    "tag_totals": """
        select n as totalTags, t as uniqueTags, m as uniqueTaggedMovies, u as uniqueTaggingUsers,
               round(n / m, 6) as avgTagsPerMovie, round(n / u, 6) as avgTagsPerUser
        from (select count(*) as n, count(distinct tag) as t, count(distinct movieId) as m,
                     count(distinct userId) as u from tags) x""",
    "popular_tags": "select * from top_tags",
    "tag_sentiment": """
        select cast(positiveTags as bigint) as positiveTags, cast(negativeTags as bigint) as negativeTags,
               round(case when negativeTags > 0 then positiveTags / negativeTags
                          when positiveTags > 0 then 'infinity'::double else 0 end, 6) as sentimentRatio
        from sentiment""",
    "genre_top_tags": "select genre, tag, tagCount, cast(rank as int) as rank from genre_tags",
    "tag_rating_affinity": "select tag, round(avgRating, 6) as avgRating, ratingCount from liked_tags",
    # --- data platform
    "dataset_sizes": """
        select r as ratingsDatasetSize, m as moviesDatasetSize, t as tagsDatasetSize, r + m + t as totalDatasetSize
        from (select (select count(*) from ratings) as r, (select count(*) from movies) as m,
                     (select count(*) from tags) as t) x""",
    "null_records": """
        select n as totalRecords, n - k as nullRecords, round(100.0::double * k / n, 6) as dataQualityScore
        from (select count(*) as n, count(*) filter (where userId is not null and movieId is not null
                  and ratingActual is not null) as k from typed_raw) x""",
    "valid_row_ratio": """
        select v as validRowsCount, n - v as invalidRowsCount, round(v / n, 6) as dataQualityRatio,
               round((1 - v / n) * 100, 6) as qualityImpactOnPerformance,
               case when v / n > 0.95 then 'Excellent data quality - optimal performance expected'
                    when v / n > 0.90 then 'Good data quality - minor performance impact'
                    when v / n > 0.80 then 'Fair data quality - moderate performance impact'
                    else 'Poor data quality - significant performance impact' end as performanceRecommendation
        from (select count(*)::double as nd, count(*) as n, count(*) filter (where userId is not null
                  and movieId is not null and ratingActual is not null
                  and timestampEpochSeconds is not null) as v from typed_raw) x""",
    "user_skew": """
        select a as minUserRatings, b as maxUserRatings, round(c, 6) as avgUserRatings,
               round(b / greatest(a, 1)::double, 6) as userDataSkewRatio, b / greatest(a, 1)::double > 100 as hasSignificantSkew
        from (select min(totalRatings) as a, max(totalRatings) as b, avg(totalRatings) as c from profile) x""",
    # --- analytics documents
    "analytics_metrics_long": f"""
        select collector, type, metric_key, label, round(value_double, 6) as value_double, value_string, value_bool
        from ({METRICS_SQL}) m""",
    "analytics_documents": f"""
        select concat(h.prefix, '_run1') as analyticsId, cast({GENERATED_AT} as bigint) as generatedAtMicros,
               m.collector, m.type, c.category, h.description, metric_key,
               round(value_double, 6) as value_double, value_string, value_bool
        from ({METRICS_SQL}) m
        join type_catalog c on c.type = m.type
        join (values
            ('DATA_QUALITY', 'DATA_QUALITY', 'data_quality', 'Comprehensive data quality analytics including completeness, freshness, and consistency'),
            ('USER_ACTIVITY', 'USER_ACTIVITY', 'user_activity', 'Comprehensive user activity, engagement, and segmentation analytics'),
            ('DATA_FRESHNESS', 'DATA_FRESHNESS', 'data_freshness', 'Data freshness and recency analytics'),
            ('CONTENT_ANALYTICS', 'MOVIE_POPULARITY', 'content_analytics_popularity', 'Movie popularity analytics including top movies and tag insights'),
            ('CONTENT_ANALYTICS', 'GENRE_DISTRIBUTION', 'content_analytics_genre', 'Genre distribution and preference analytics'),
            ('CONTENT_ANALYTICS', 'CONTENT_PERFORMANCE', 'content_analytics_performance', 'Content performance analytics including ratings variability and polarization'),
            ('USER_ENGAGEMENT', 'USER_ENGAGEMENT', 'user_engagement', 'User engagement depth and interaction pattern analytics'),
            ('RATING_DISTRIBUTION', 'RATING_DISTRIBUTION', 'rating_distribution', 'Rating distribution analytics showing rating patterns and user preferences'),
            ('USER_SEGMENTATION', 'USER_SEGMENTATION', 'user_segmentation', 'User segmentation and behavior pattern analytics'),
            ('TEMPORAL_TRENDS', 'TEMPORAL_TRENDS', 'temporal_trends', 'Temporal trends and seasonal pattern analytics'),
            ('TAG_ANALYTICS', 'USER_ENGAGEMENT', 'user_perspective_tags', 'User perspective analytics through tags showing how users perceive and describe movies'),
            ('SYSTEM_PERFORMANCE', 'PROCESSING_PERFORMANCE', 'processing_performance', 'Batch processing performance and efficiency analytics')
        ) h(collector, type, prefix, description) on h.collector = m.collector and h.type = m.type""",
    # Eleven keys of the last collector differ in value from run to run, but not in number.
    "analytics_run_status": f"""
        select collector, 'SUCCESS' as status, cast(null as varchar) as message,
               count(distinct type) as documents,
               count(distinct concat(type, '.', metric_key))
                   + case when collector = 'SYSTEM_PERFORMANCE' then 11 else 0 end as metrics
        from ({METRICS_SQL}) m group by collector""",
    "analytics_upsert": f"select {DOC_COLUMNS}, metricValue from ({LATEST_VERSIONS}) v",
    "analytics_query": " union all ".join(
        f"""select * from (select '{case}' as "case", {DOC_COLUMNS} from analytics_docs where {condition}
            order by {order}, analyticsId limit {size} offset {page * size}) c_{case}"""
        for case, condition, order, page, size in DOC_CASES
    ),
    "analytics_count": " union all ".join(
        f"""select '{case}' as "case", n as totalElements, cast(ceil(n / {size}) as bigint) as totalPages,
                   {page} < ceil(n / {size}) - 1 as hasNext, {page} > 0 as hasPrevious
            from (select count(*) as n from analytics_docs where {condition}) c_{case}"""
        for case, condition, _, page, size in DOC_CASES
    ),
    "analytics_by_id": f"""
        select {DOC_COLUMNS}, round(metricValue, 6) as metricValue from analytics_docs where analyticsId = 'doc_16'""",
    "analytics_counts_by_type": """
        select c.type, c.category, c.typeDescription, count(*) as documents
        from analytics_docs d join type_catalog c on c.type = d.type group by all""",
    "analytics_counts_by_category": """
        select c.category, count(*) as documents
        from analytics_docs d join type_catalog c on c.type = d.type group by all""",
    "analytics_summary": """
        select t.n as totalAnalytics, t.k as uniqueTypes, t.latest as latestMicros, t.oldest as oldestMicros,
               c.category, count(*) as categoryCount, round(100.0::double * count(*) / t.n, 6) as categoryPercentage
        from analytics_docs d join type_catalog c on c.type = d.type
        cross join (select count(*) as n, count(distinct type) as k, max(generatedAtMicros) as latest,
                           min(generatedAtMicros) as oldest from analytics_docs) t
        group by t.n, t.k, t.latest, t.oldest, c.category""",
    "analytics_exists_by_type": """
        select type, type in (select type from analytics_docs) as "exists" from type_catalog""",
    "analytics_latest_by_type": f"""
        select {DOC_COLUMNS}, round(metricValue, 6) as metricValue from (
            select *, row_number() over (partition by type order by generatedAtMicros desc, analyticsId) as newest
            from analytics_docs) d where newest = 1""",
    "analytics_type_catalog": """
        select c.*, category = 'Data Quality' as isDataQuality, category = 'User Behavior' as isUserBehavior,
               category = 'Content Analytics' as isContentAnalytics,
               category = 'System Performance' as isSystemPerformance,
               (select count(*) from analytics_docs d where d.type = c.type) as documents
        from type_catalog c""",
    # --- charts
    "chart_rating_distribution": """
        select ratingActual as rating, concat(cast(ratingActual as varchar), '★') as label, n as ratingCount,
               round(100.0::double * n / (select sum(n) from histogram), 1) as percentage from histogram""",
    "chart_engagement": """
        select name, n as value, round(100.0::double * n / (select count(*) from profile), 1) as percentage from (
            select 'Low Engaged' as name, count(*) as n from profile where totalRatings < 10
            union all select 'Moderately Engaged', count(*) from profile where totalRatings between 10 and 50
            union all select 'Highly Engaged', count(*) from profile where totalRatings > 50) t""",
    "chart_segmentation": """
        select a.activity, count(*) filter (where ratingPattern = 'Critical') as critical,
               count(*) filter (where ratingPattern = 'Neutral') as neutral,
               count(*) filter (where ratingPattern = 'Positive') as positive
        from (values ('Low'), ('Medium'), ('High')) a(activity)
        left join labels_of l on l.activityLevel = a.activity group by a.activity""",
    "chart_top_movies": """
        select movieId, title, ratingsCount as ratings, round(avgRating, 6) as avgRating, genres
        from top10 where title is not null order by ratingsCount desc, movieId limit 5""",
    "chart_genre_popularity": """
        select genre, ratingCount, round(avgRating, 6) as avgRating, uniqueUsers
        from genre_agg order by ratingCount desc, genre limit 12""",
    "chart_genre_quality": """
        select genre, round(avgRating, 6) as avgRating, ratingCount
        from genre_agg where ratingCount > 5000 order by genre_agg.avgRating desc, genre limit 10""",
    "chart_monthly": """
        select strftime(make_date(2000, cast(month as int), 1), '%b') as month, count(*) as ratingCount,
               round(avg(ratingActual), 6) as avgRating from calendar c group by c.month""",
    "chart_yearly": """
        select cast(year as int) as year, count(*) as ratingCount, round(avg(ratingActual), 6) as avgRating,
               count(distinct userId) as activeUsers from calendar where year between 1995 and 2023 group by year""",
    "chart_weekly": """
        select any_value(strftime(moment, '%a')) as day, count(*) as ratingCount, round(avg(ratingActual), 6) as avgRating
        from calendar group by dayOfWeek""",
    "metric_numeric_value": """
        select event_id as eventId,
               case event_id % 5 when 0 then concat('{"$numberLong": "', event_id * 1000, '"}')
                    when 1 then concat('{"$date": "', strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'Z"}')
                    when 2 then cast(value as varchar)
                    when 3 then concat('"', event_type, '"') end as raw,
               case event_id % 5 when 0 then event_id * 1000.0::double
                    when 1 then epoch_ms(date_trunc('second', ts))::double
                    when 2 then round(value, 6) else 0 end as value
        from events""",
    # --- collaborative filtering
    "train_test_split": """
        select count(*) as rows, round(sum(ratingActual), 6) as ratingSum,
               count(distinct (userId, movieId, timestampEpochSeconds)) as distinctRows, true as shareIsClose
        from ratings""",
    "als_train": """
        select 'user' as side, count(distinct userId) as entities, count(distinct userId) as usable, 10 as rank from ratings
        union all
        select 'item', count(distinct movieId), count(distinct movieId), 10 from ratings""",
    # Models differ from engine to engine; what must hold of any is stated as true.
    "als_rmse": "select count(*) as ratings, true as errorOfFactors, true as errorOnScale from ratings",
    "als_predict": """
        select distinct userId, movieId, true as productOfFactors from interactions
        where userId in (select userId from ratings) and movieId in (select movieId from ratings)""",
    "als_recommend_all": """
        select userId, least(10, n) as movies, least(10, n) as distinctMovies, true as bestFirst, true as noneBetterLeftOut
        from (select distinct userId, (select count(distinct movieId) from ratings) as n from ratings) u""",
    "als_recommend_subset": """
        select userId, least(10, n) as movies, true as sameAsAmongAll
        from (select distinct userId, (select count(distinct movieId) from ratings) as n from ratings
              where userId in (select userId from interactions)) u""",
    "item_similar_items_ann": """
        select itemId, least(5, (select count(*) from item_factors) - 1) as neighbors, true as different, true as cosinesAreTrue,
               true as nearestFirst, true as mostNeighborsFound, true as comparesLess
        from item_factors""",
    "partition_profile": """
        select count(*) as totalRecords, count(*) * 32 as estimatedMemoryUsageBytes, true as averageTimesPartitions,
               true as averageBetweenEnds, true as flagFollowsAverage
        from ratings""",
    "run_timing": """
        select count(*) as totalRecords, true as runTook, true as checkTook, true as speedFollowsTime, true as labelFollowsSpeed,
               true as scoreFollowsCheck
        from ratings""",
    # --- recommendation documents
    "recs_enriched": f"select * exclude (totalRecommendations) from ({rec_rows()}) r",
    "recs_upsert": f"""
        select d.userId, d.generatedAt, d.modelVersion, cast(d.rk as int) as position, movieId,
               round(d.rating, 6) as rating, m.title, m.genreNames
        from (select * from ({best_ten('timestampEpochSeconds >= 946684800', GENERATED_AT, 'v2')}) l
              union all
              select * from ({best_ten('timestampEpochSeconds < 946684800', GENERATED_AT - 1, 'v1')}) e
              where e.userId not in (select userId from ratings where timestampEpochSeconds >= 946684800)) d
        {TITLED}""",
    "recs_by_user": rec_rows("userId in (select userId from interactions)"),
    "recs_by_user_topn": rec_rows("userId in (select userId from interactions)", top=3),
    "recs_batch": rec_rows("userId in (1, 2, 3, 77, 999999)", top=4),
    "recs_exists": """
        select distinct userId, userId in (select userId from ratings) as "exists" from interactions""",
    # --- vectors
    "factor_table": f"""
        select concat('vector:', entity_type, ':', entity_id) as key, entity_id, entity_type,
               cast(len(features) as int) as dimension, cast(len(features) * 4 as int) as byteLength,
               round(list_sum(features), 4) as featureSum, cast({GENERATED_AT} as bigint) as timestamp,
               'v1' as model_version
        from (select userId as entity_id, 'user' as entity_type, features from user_factors
              union all select itemId, 'item', features from item_factors) f""",
    "vector_validation": """
        select cast(vec_id + 1 as int) as itemId,
               cast(case when vec_id % 13 = 0 or vec_id % 17 = 0 then 0
                         else len(embedding) + 1 end as int) as dimension,
               case when vec_id % 13 = 0 then 'NULL_VECTOR' when vec_id % 17 = 0 then 'EMPTY_VECTOR'
                    else 'NON_FINITE_VALUE' end as reason
        from embeddings where vec_id % 13 = 0 or vec_id % 17 = 0 or vec_id % 19 = 0 or vec_id % 23 = 0""",
    "item_similar_items": """
        select itemId, cast(place as int) as rank, otherId as neighborId, round(cosine, 4) as cosine from (
            select itemId, otherId, cosine, row_number() over (partition by itemId order by rank) as place
            from item_near where itemId <> otherId) n where place <= 5""",
    "user_similar_items": """
        select userId, cast(rank as int) as rank, movieId, round(cosine, 4) as cosine,
               round(least(5.0, cosine * 1.2 * 5), 4) as score
        from (select userId, movieId, cosine,
                     row_number() over (partition by userId order by cosine desc, movieId) as rank
              from (select u.userId, i.itemId as movieId,
                           round(list_cosine_similarity(u.features, i.features), 9) as cosine
                    from user_factors u cross join item_factors i) p) n where rank <= 5""",
    # --- real time
    "event_normalize": "select eventId, eventType, weight from events_named",
    "event_validate": f"""
        select eventId, userId, coalesce(movieId, 0) as movieId, eventType, rating,
               case when movieId is null then {GENERATED_AT} else tsMicros end as tsMicros,
               reason is null as accepted, reason
        from (select *, case when userId <= 0 then 'USER_NOT_POSITIVE'
                             when eventType = 'UNKNOWN' then 'UNKNOWN_EVENT_TYPE'
                             when movieId <= 0 then 'MOVIE_NOT_POSITIVE'
                             when eventType = 'RATING_GIVEN' and rating is null then 'RATING_MISSING'
                             when eventType = 'RATING_GIVEN' and not rating between 0.5 and 5.0
                             then 'RATING_OUT_OF_RANGE' end as reason from events_named) e""",
    "event_rec_budget": "select eventId, eventType, weight, k, multiplier from events_named",
    "rt_recommendations": """
        select eventId, userId, seedMovieId, cast(position as int) as position, movieId, round(score, 4) as score
        from event_recs""",
    "rt_processed_events": "select eventId, userId, movieId, eventType, true as processed from processed",
    "rt_output_messages": "select * from messages",
    "rt_recs_for_user": "select * from messages where key = '42'",
}

STATEMENTS: dict[str, str] = {name: with_views(sql) for name, sql in _PLAIN.items()}
