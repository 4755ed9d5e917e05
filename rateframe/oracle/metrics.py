"""Every collector metric as one DuckDB relation (collector, type, metric_key, label, value_*)."""

from __future__ import annotations

FRESHNESS_AS_OF = 1011052800


def one_row(collector: str, kind: str, relation: str, metrics: dict[str, str]) -> str:
    """Metrics that are single values over one relation."""
    rows = ", ".join(f"('{key}', cast({value} as double))" for key, value in metrics.items())
    return f"""
        select '{collector}' as collector, '{kind}' as type, k.metric_key, null as label,
               k.v as value_double, null as value_string, null as value_bool
        from (select * from ({relation}) r0) r, lateral (values {rows}) k(metric_key, v)"""


def keyed(collector: str, kind: str, relation: str, key: str, value: str, label: str = "null", text: bool = False) -> str:
    number, string = ("null", value) if text else (f"cast({value} as double)", "null")
    return f"""
        select '{collector}', '{kind}', {key}, {label}, {number}, {string}, null from ({relation}) r"""


def constant(collector: str, kind: str, key: str, number: str = "null", string: str = "null", flag: str = "null") -> str:
    return f"select '{collector}', '{kind}', '{key}', null, {number}, {string}, {flag}"


SPAN = "((newest - oldest) // 86400)"
PROFILE = """select count(*) as n, avg(totalRatings) as a, min(totalRatings) as lo, max(totalRatings) as hi,
    quantile_disc(totalRatings, 0.5) as med, avg(avgRating) as ar, avg(ratingStdDev) as sd,
    avg(uniqueMovies) as um, avg(engagementSpan) as sp, stddev_samp(totalRatings) as va,
    stddev_samp(avgRating) as vr, quantile_disc(uniqueMovies, 0.5) as medu, max(uniqueMovies) as hiu,
    count(*) filter (where totalRatings > 50) as t50, count(*) filter (where totalRatings between 10 and 50) as t10,
    count(*) filter (where totalRatings < 10) as t0,
    count(*) filter (where activityLevel = 'High') as h, count(*) filter (where activityLevel = 'Medium') as m,
    count(*) filter (where activityLevel = 'Low') as l, count(*) filter (where ratingPattern = 'Positive') as p,
    count(*) filter (where ratingPattern = 'Neutral') as u, count(*) filter (where ratingPattern = 'Critical') as c
    from labels_of"""
MAXSHARE = "greatest(h, m, l) * 100.0::double / n"
MOVIES = """select count(*) as n, avg(totalRatings) as a, min(totalRatings) as lo, max(totalRatings) as hi,
    quantile_disc(totalRatings, 0.5) as med, avg(avgRating) as ar, avg(ratingStdDev) as sd,
    avg(uniqueRaters) as um, count(*) filter (where avgRating > 4.0) as g,
    count(*) filter (where avgRating < 2.5) as b, count(*) filter (where ratingStdDev > 1.5) as x from performance"""
SAFE_TAG = "lower(regexp_replace(tag, '[^a-zA-Z0-9]', '', 'g'))"
SAFE_GENRE = "lower(regexp_replace(genre, '[^a-zA-Z0-9]', '', 'g'))"

DQ, DF, RD, UA, US, UE, TT = (
    "DATA_QUALITY", "DATA_FRESHNESS", "RATING_DISTRIBUTION", "USER_ACTIVITY",
    "USER_SEGMENTATION", "USER_ENGAGEMENT", "TEMPORAL_TRENDS",
)
CA, MP, GD, CP = "CONTENT_ANALYTICS", "MOVIE_POPULARITY", "GENRE_DISTRIBUTION", "CONTENT_PERFORMANCE"
TA, SP, PP = "TAG_ANALYTICS", "SYSTEM_PERFORMANCE", "PROCESSING_PERFORMANCE"

RATING_ROW = """select count(*) as n, avg(ratingActual) as a, min(ratingActual) as lo, max(ratingActual) as hi,
    stddev_samp(ratingActual) as sd, count(distinct ratingActual) as k,
    count(*) filter (where ratingActual >= 4.0) as h,
    count(*) filter (where ratingActual between 2.5 and 3.9) as m, count(*) filter (where ratingActual < 2.5) as l,
    quantile_cont(ratingActual, 0.25) as q1, quantile_cont(ratingActual, 0.5) as q2,
    quantile_cont(ratingActual, 0.75) as q3,
    count(*) filter (where movieId in (select movieId from movies)) as w,
    (select count(*) from (select distinct * from ratings) d) as uniq,
    count(*) filter (where timestampEpochSeconds > %d) as fut from ratings""" % FRESHNESS_AS_OF
RECENCY = {
    "recentRatings30Days": "r30",
    "recentActivityPercentage": "100.0::double * r30 / n",
}
SPAN_KEYS = {
    "oldestRatingTimestamp": "oldest",
    "newestRatingTimestamp": "newest",
    "timeSpanDays": SPAN,
    "ratingsPerDay": f"n / greatest({SPAN}, 1)::double",
    "ratingsPerHour": f"n / greatest({SPAN}, 1)::double / 24",
}
ENGAGEMENT = {
    "avgRatingsPerUser": "a", "avgUserRating": "ar", "avgRatingStdDev": "sd",
    "avgUniqueMoviesPerUser": "um", "avgEngagementSpanSeconds": "sp",
}
AGE = f"({FRESHNESS_AS_OF} - newest)"
MOST = "(select * from histogram order by n desc, ratingActual limit 1)"
LEAST = "(select * from histogram order by n, ratingActual limit 1)"


def prefixed(prefix: str, metrics: dict[str, str]) -> dict[str, str]:
    return {prefix + key: value for key, value in metrics.items()}


PARTS: list[str] = [
    # DATA_QUALITY
    one_row(DQ, DQ, RATING_ROW, {
        "completeness_totalRows": "n",
        **{f"completeness_{c}Completeness": "100" for c in ("userId", "movieId", "rating", "timestamp", "overall")},
        "completeness_uniqueRecords": "uniq",
        "completeness_duplicateRecords": "n - uniq",
        "completeness_duplicatePercentage": "100.0::double * (n - uniq) / n",
        "consistency_minRating": "lo", "consistency_maxRating": "hi", "consistency_uniqueRatingValues": "k",
        "consistency_ratingsWithMovieData": "w", "consistency_orphanedRatings": "n - w",
        "consistency_orphanedPercentage": "100.0::double * (n - w) / n",
        "consistency_futureTimestamps": "fut", "consistency_invalidTimestamps": "0",
        "consistency_overallScore": "100",
    }),
    constant(DQ, DQ, "consistency_ratingsInValidRange", flag="true"),
    one_row(DQ, DQ, "select * from overview", prefixed("freshness_", SPAN_KEYS)),
    one_row(DQ, DQ, "select * from recent", prefixed("freshness_", RECENCY)),
    one_row(DQ, DQ, """select (select count(*) from tags) as n, (select count(*) from tags t semi join ratings r
            on r.movieId = t.movieId and r.userId = t.userId) as w""", {
        "consistency_tagsWithRatingData": "w", "consistency_orphanedTags": "n - w",
        "consistency_orphanedTagsPercentage": "100.0::double * (n - w) / n",
    }),
    # DATA_FRESHNESS
    one_row(DF, DF, "select * from overview", {
        **SPAN_KEYS,
        "dataAgeSeconds": AGE, "dataAgeDays": f"{AGE} // 86400",
        "freshnessScore": f"""100 - case when {AGE} // 86400 > 365 then 50 when {AGE} // 86400 > 90 then 30
            when {AGE} // 86400 > 30 then 15 when {AGE} // 86400 > 7 then 5 else 0 end""",
    }),
    one_row(DF, DF, "select * from recent", {
        **RECENCY, "ratingsLast7Days": "r7", "ratingsLast24Hours": "r1",
        "weeklyActivityPercentage": "100.0::double * r7 / n", "dailyActivityPercentage": "100.0::double * r1 / n",
    }),
    keyed(DF, DF, "select * from recent", "'activityTrend'",
          """case when r1 > r7 / 7.0::double then 'Increasing' when r1 < r7 / 14.0::double then 'Decreasing'
             else 'Stable' end""", text=True),
    # RATING_DISTRIBUTION
    keyed(RD, RD, "select * from histogram", "concat('rating_', cast(ratingActual as varchar))", "n"),
    one_row(RD, RD, RATING_ROW, {
        "totalRatings": "n", "avgRating": "a", "minRating": "lo", "maxRating": "hi", "stdDevRating": "sd",
        "highRatings": "h", "mediumRatings": "m", "lowRatings": "l",
        "highRatingsPercentage": "100.0::double * h / n", "mediumRatingsPercentage": "100.0::double * m / n",
        "lowRatingsPercentage": "100.0::double * l / n", "uniqueRatingValues": "k",
        "ratingQ1": "q1", "ratingMedian": "q2", "ratingQ3": "q3", "ratingIQR": "q3 - q1",
    }),
    one_row(RD, RD, f"select * from {MOST} m", {"mostCommonRating": "ratingActual", "mostCommonRatingCount": "n"}),
    one_row(RD, RD, f"select * from {LEAST} m", {"leastCommonRating": "ratingActual", "leastCommonRatingCount": "n"}),
    # USER_ACTIVITY
    one_row(UA, UA, PROFILE, {
        "totalUsers": "n", "avgRatingsPerUser": "a", "minRatingsPerUser": "lo", "maxRatingsPerUser": "hi",
        "medianRatingsPerUser": "med", **prefixed("engagement_", ENGAGEMENT),
        "highlyEngagedUsers": "t50", "moderatelyEngagedUsers": "t10", "lowEngagedUsers": "t0",
        "segmentation_totalUsers": "n", "segmentation_highActivityUsers": "h",
        "segmentation_mediumActivityUsers": "m", "segmentation_lowActivityUsers": "l",
        "segmentation_highActivityPercentage": "100.0::double * h / n",
    }),
    keyed(UA, UA, "select * from profile order by totalRatings desc, userId limit 10",
          "concat('topUser_', userId, '_ratingsCount')", "totalRatings"),
    *[keyed(c, c, "select activityLevel, ratingPattern, count(*) as n from labels_of group by all",
            "concat('segment_', activityLevel, '_', ratingPattern)", "n") for c in (UA, US)],
    # USER_SEGMENTATION
    one_row(US, US, PROFILE, {
        "totalUsers": "n", "highActivityUsers": "h", "mediumActivityUsers": "m", "lowActivityUsers": "l",
        "positiveUsers": "p", "neutralUsers": "u", "criticalUsers": "c",
        "highActivityPercentage": "100.0::double * h / n", "mediumActivityPercentage": "100.0::double * m / n",
        "lowActivityPercentage": "100.0::double * l / n", "positiveUsersPercentage": "100.0::double * p / n",
        "neutralUsersPercentage": "100.0::double * u / n", "criticalUsersPercentage": "100.0::double * c / n",
        "avgRatingsAcrossUsers": "a", "avgRatingAcrossUsers": "ar", "avgUniqueMoviesAcrossUsers": "um",
        "activityVariation": "va", "ratingVariation": "vr", "maxSegmentPercentage": MAXSHARE,
        "segmentationEffectivenessScore":
            f"100 - case when {MAXSHARE} > 80 then 30 when {MAXSHARE} > 70 then 20 when {MAXSHARE} > 60 then 10 else 0 end",
    }),
    keyed(US, US, "select engagementLevel, ratingConsistency, count(*) as n from labels_of group by all",
          "concat('advancedSegment_', engagementLevel, '_', ratingConsistency)", "n"),
    # USER_ENGAGEMENT
    one_row(UE, UE, PROFILE, {
        **ENGAGEMENT, "highlyEngagedUsers": "t50", "moderatelyEngagedUsers": "t10", "lowEngagedUsers": "t0",
        "totalEngagedUsers": "n", "highEngagementPercentage": "100.0::double * t50 / n",
        "moderateEngagementPercentage": "100.0::double * t10 / n", "lowEngagementPercentage": "100.0::double * t0 / n",
        "medianRatingsPerUser": "med", "medianUniqueMoviesPerUser": "medu",
        "maxRatingsPerUser": "hi", "maxUniqueMoviesPerUser": "hiu",
        "engagementConsistencyScore": "100 - case when sd > 2.0 then 30 when sd > 1.5 then 20 when sd > 1.0 then 10 else 0 end",
    }),
    keyed(UE, UE, "select ratingFrequency, ratingDiversity, count(*) as n from labels_of group by all",
          "concat('behavior_', ratingFrequency, '_', ratingDiversity)", "n"),
    # TEMPORAL_TRENDS
    *[
        keyed(TT, TT, f"""select {part}, count(*) as ratingCount, avg(ratingActual) as avgRating,
                count(distinct userId) as activeUsers from calendar group by {part} {tail}""",
              f"concat('{stem}_', {part}, '_{suffix}')", value)
        for stem, part, tail, metrics in (
            ("year", "year", "", (("count", "ratingCount"), ("avgRating", "avgRating"), ("activeUsers", "activeUsers"))),
            ("month", "month", "", (("count", "ratingCount"), ("avgRating", "avgRating"))),
            ("dayOfWeek", "dayOfWeek", "", (("count", "ratingCount"), ("avgRating", "avgRating"))),
            ("topHour", "hour", "order by count(*) desc, hour limit 5",
             (("count", "ratingCount"), ("avgRating", "avgRating"))),
        )
        for suffix, value in metrics
    ],
    # MOVIE_POPULARITY
    one_row(CA, MP, MOVIES, {
        "popularity_totalMovies": "n", "popularity_avgRatingsPerMovie": "a", "popularity_minRatingsPerMovie": "lo",
        "popularity_maxRatingsPerMovie": "hi", "popularity_medianRatingsPerMovie": "med",
        "popularity_overallAvgRating": "ar",
    }),
    keyed(CA, MP, "select * from top10", "concat('topMovie_', movieId, '_ratingsCount')", "ratingsCount"),
    keyed(CA, MP, "select * from top10 where title is not null", "concat('topMovie_', movieId, '_avgRating')", "avgRating"),
    *[keyed(CA, MP, "select * from top10 where title is not null", f"concat('topMovie_', movieId, '_{c}')", c, text=True)
      for c in ("title", "genres")],
    keyed(CA, MP, "select * from top10_tags", "concat('topMovie_', movieId, '_tag', rank, '_name')", "tag", text=True),
    keyed(CA, MP, "select * from top10_tags", "concat('topMovie_', movieId, '_tag', rank, '_count')", "tagCount"),
    constant(CA, MP, "tagAnalysisAvailable", flag="true"),
    # GENRE_DISTRIBUTION
    keyed(CA, GD, "select * from genre_agg", f"concat('genre_', {SAFE_GENRE}, '_name')", "genre", "genre", text=True),
    *[keyed(CA, GD, "select * from genre_agg", f"concat('genre_', {SAFE_GENRE}, '_{suffix}')", value, "genre")
      for suffix, value in (("count", "ratingCount"), ("avgRating", "avgRating"), ("uniqueUsers", "uniqueUsers"),
                            ("uniqueMovies", "uniqueMovies"), ("ratingStdDev", "coalesce(ratingStdDev, 0)"))],
    one_row(CA, GD, "select count(*) as n from genre_agg", {"totalGenres": "n"}),
    constant(CA, GD, "genreDataAvailable", flag="true"),
    *[
        part
        for name, count, order in (
            ("mostPopularGenre", "Count", "ratingCount desc"), ("leastPopularGenre", "Count", "ratingCount"),
            ("bestRatedGenre", "Avg", "avgRating desc"), ("worstRatedGenre", "Avg", "avgRating"),
        )
        for part in (
            keyed(CA, GD, f"select * from genre_agg order by {order}, genre limit 1", f"'{name}'", "genre", text=True),
            keyed(CA, GD, f"select * from genre_agg order by {order}, genre limit 1", f"'{name}{count}'",
                  "ratingCount" if count == "Count" else "avgRating"),
        )
    ],
    # CONTENT_PERFORMANCE
    one_row(CA, CP, MOVIES, {
        "performance_totalMovies": "n", "performance_avgRatingsPerMovie": "a", "performance_overallAvgRating": "ar",
        "performance_avgRatingVariability": "sd", "performance_avgUniqueRatersPerMovie": "um",
        "performance_highRatedMovies": "g", "performance_lowRatedMovies": "b", "performance_polarizingMovies": "x",
    }),
    # Tags
    one_row(TA, UE, """select count(*) as n, count(distinct tag) as t, count(distinct movieId) as m,
            count(distinct userId) as u from tags""", {
        "totalTags": "n", "uniqueTags": "t", "uniqueTaggedMovies": "m", "uniqueTaggingUsers": "u",
        "avgTagsPerMovie": "n / m", "avgTagsPerUser": "n / u",
    }),
    keyed(TA, UE, "select * from top_tags", f"concat('popularTag_', {SAFE_TAG}, '_name')", "tag", "tag", text=True),
    *[keyed(TA, UE, "select * from top_tags", f"concat('popularTag_', {SAFE_TAG}, '_{suffix}')", value, "tag")
      for suffix, value in (("count", "tagCount"), ("moviesTagged", "moviesTagged"), ("usersWhoTagged", "usersWhoTagged"))],
    one_row(TA, UE, "select * from sentiment", {
        "positiveTags": "positiveTags", "negativeTags": "negativeTags", "sentimentRatio": "positiveTags / negativeTags",
    }),
    keyed(TA, UE, "select * from genre_tags", f"concat('genre_', {SAFE_GENRE}, '_topTag', rank, '_name')", "tag", "genre", text=True),
    keyed(TA, UE, "select * from genre_tags", f"concat('genre_', {SAFE_GENRE}, '_topTag', rank, '_count')", "tagCount", "genre"),
    keyed(TA, UE, "select * from liked_tags", f"concat('highRatedTag_', {SAFE_TAG}, '_name')", "tag", "tag", text=True),
    keyed(TA, UE, "select * from liked_tags", f"concat('highRatedTag_', {SAFE_TAG}, '_avgRating')", "avgRating", "tag"),
    keyed(TA, UE, "select * from liked_tags", f"concat('highRatedTag_', {SAFE_TAG}, '_ratingCount')", "ratingCount", "tag"),
    *[constant(TA, UE, key, flag="true")
      for key in ("tagDataAvailable", "genreTagAnalysisAvailable", "tagRatingCorrelationAvailable")],
    # PROCESSING_PERFORMANCE without what differs from run to run
    one_row(SP, PP, """select (select count(*) from ratings) as r, (select count(*) from movies) as m,
            (select count(*) from tags) as t, min(totalRatings) as lo, max(totalRatings) as hi,
            avg(totalRatings) as a from profile""", {
        "totalRecords": "r", "nullRecords": "0", "dataQualityScore": "100",
        "ratingsDatasetSize": "r", "moviesDatasetSize": "m", "tagsDatasetSize": "t", "totalDatasetSize": "r + m + t",
        "minUserRatings": "lo", "maxUserRatings": "hi", "avgUserRatings": "a",
        "userDataSkewRatio": "hi / greatest(lo, 1)::double",
        "validRowsCount": "r", "invalidRowsCount": "0", "dataQualityRatio": "1", "qualityImpactOnPerformance": "0",
    }),
    """select 'SYSTEM_PERFORMANCE', 'PROCESSING_PERFORMANCE', 'hasSignificantSkew', null, null, null,
           max(totalRatings) / greatest(min(totalRatings), 1)::double > 100 from profile""",
    constant(SP, PP, "performanceRecommendation", string="'Excellent data quality - optimal performance expected'"),
]

METRICS_SQL = "\nunion all\n".join(PARTS)
