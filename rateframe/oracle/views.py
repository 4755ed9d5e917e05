"""The derived inputs as DuckDB SQL, to be put in front of a statement as WITH clauses."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {
    "base": """
        select l_orderkey, l_linenumber, l_suppkey, l_quantity, ts, step, userId,
               case when userId <= 10 then l_partkey % 100
                    when userId <= 20 then l_partkey % 400
                    else l_partkey end + 1 as movieId
        from (
            select l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity,
                   cast(epoch(l_shipdate) as bigint) + (l_orderkey % 24) * 3600 + l_linenumber * 60 as ts,
                   cast(round(l_discount * 100) as int) as step,
                   case when o_custkey % 3 = 0 then o_custkey % 50 else o_custkey end + 1 as userId
            from lineitem join orders on l_orderkey = o_orderkey
        ) b""",
    "raw_once": """
        select l_orderkey,
               case when l_orderkey % 307 = 0 then null else cast(userId as varchar) end as userId,
               cast(movieId as varchar) as movieId,
               case when l_orderkey % 211 = 0 then 'bad'
                    else cast(cast(st + 1 as double) / 2 as varchar) end as rating,
               cast(ts as varchar) as "timestamp"
        from (
            select base.*, case when movieId % 50 = 0 then greatest(step, 8)
                                when movieId % 50 = 1 then least(step, 2)
                                when userId % 5 = 0 then greatest(step, 7)
                                when userId % 5 = 1 then least(step, 3)
                                else step end as st
            from base
        ) x""",
    "raw_ratings": """
        select userId, movieId, rating, "timestamp" from raw_once
        union all
        select userId, movieId, rating, "timestamp" from raw_once where l_orderkey % 500 = 0""",
    "typed_raw": """
        select try_cast(userId as int) as userId, try_cast(movieId as int) as movieId,
               try_cast(rating as double) as ratingActual,
               try_cast("timestamp" as bigint) as timestampEpochSeconds
        from raw_ratings""",
    "ratings": """
        select * from typed_raw
        where userId > 0 and movieId > 0 and ratingActual between 0.5 and 5.0
          and timestampEpochSeconds is not null""",
    "movies": """
        select cast(case when p_partkey % 97 = 0 then p_partkey + 1000001 else p_partkey + 1 end as int) as movieId, p_name as title,
               case when p_size % 17 = 0 then '(no genres listed)'
                    else concat(p_type, '|', split_part(p_name, ' ', 2)) end as genres
        from part""",
    "movie_genres": """
        select movieId, genre
        from (select movieId, unnest(string_split(genres, '|')) as genre from movies) g
        where genre <> '(no genres listed)' and length(genre) > 0""",
    "tags": """
        select cast(userId as int) as userId,
               cast(case when l_suppkey % 20 = 0 then movieId + 1000000 else movieId end as int) as movieId,
               (['great plot','boring','amazing visuals','awful acting','classic','perfect score',
                 'worst ending','twist','good but bad','sci-fi','dark','based on a book'])
                 [cast(l_quantity as int) % 12 + 1] as tag,
               cast(ts as bigint) as "timestamp"
        from base""",
    "interactions": """
        select event_id as eventId, cast(user_id + 1 as int) as userId,
               case when event_id % 50 = 0 then null
                    else cast(json_extract_string(props, '$.k') as int) + 1 end as movieId,
               case event_type when 'purchase' then 'RATING_GIVEN'
                               when 'view' then 'movie-viewed'
                               when 'signup' then 'ADDED_TO_WATCHLIST'
                               when 'click' then case when value > 150 then 'SEARCHED_FOR_MOVIE'
                                                      else 'MOVIE_CLICKED' end
                               else 'error' end as eventType,
               case when event_type = 'purchase'
                    then cast(cast(floor(value) as int) % 12 as double) / 2 end as rating,
               epoch_us(ts) as tsMicros
        from events""",
    "item_factors": """
        select cast(case when vec_id % 11 = 0 then vec_id + 1000001 else vec_id + 1 end as int) as itemId,
               cast(embedding as double[]) as features
        from embeddings""",
    "user_factors": """
        select cast(case when vec_id % 7 = 0 then vec_id + 1000001 else vec_id + 1 end as int) as userId,
               cast(embedding as double[]) as features
        from embeddings""",
    "recs": """
        select userId, movieId, rating, rk from (
            select userId, movieId, rating,
                   row_number() over (partition by userId order by rating desc, movieId) as rk
            from (select userId, movieId, avg(ratingActual) as rating from ratings group by userId, movieId) a
        ) b where rk <= 10""",
    "analytics_docs": """
        select concat(case when event_id % 9 = 0 then 'other_' else 'doc_' end, cast(event_id as varchar)) as analyticsId, epoch_us(ts) as generatedAtMicros,
               (['DATA_COMPLETENESS','DATA_FRESHNESS','DATA_QUALITY','USER_ACTIVITY','USER_ENGAGEMENT',
                 'USER_SEGMENTATION','MOVIE_POPULARITY','CONTENT_PERFORMANCE','RATING_DISTRIBUTION',
                 'GENRE_DISTRIBUTION','TEMPORAL_TRENDS','PROCESSING_PERFORMANCE','USER_SATISFACTION',
                 'MYSTERY_TYPE'])[cast(event_id % 14 as int) + 1] as type,
               concat('Report on ', event_type, ' by user ', cast(user_id as varchar)) as description,
               value as metricValue
        from events""",
    "type_catalog": """
        select * from (values
            ('DATA_COMPLETENESS', 'Data Quality', 'Tracks completeness and integrity of rating data'),
            ('DATA_FRESHNESS', 'Data Quality', 'Monitors freshness and recency of rating data'),
            ('DATA_QUALITY', 'Data Quality', 'Comprehensive data quality metrics'),
            ('USER_ACTIVITY', 'User Behavior', 'Tracks user rating patterns and activity levels'),
            ('USER_ENGAGEMENT', 'User Behavior', 'Measures user engagement depth and interaction quality'),
            ('USER_SEGMENTATION', 'User Behavior', 'Segments users based on rating behavior patterns'),
            ('MOVIE_POPULARITY', 'Content Analytics', 'Tracks movie popularity and rating frequency'),
            ('CONTENT_PERFORMANCE', 'Content Analytics', 'Analyzes overall content performance metrics'),
            ('RATING_DISTRIBUTION', 'Content Analytics', 'Analyzes distribution of rating values'),
            ('GENRE_DISTRIBUTION', 'Content Analytics', 'Tracks genre preferences and distribution patterns'),
            ('TEMPORAL_TRENDS', 'Content Analytics', 'Identifies temporal trends and seasonal patterns'),
            ('PROCESSING_PERFORMANCE', 'System Performance', 'Monitors batch processing performance metrics'),
            ('USER_SATISFACTION', 'Business Metrics', 'Tracks user satisfaction with recommendations')
        ) t(type, category, typeDescription)""",
    "event_weights": """
        select * from (values ('RATING_GIVEN', 5.0::double, 5, 2.0::double), ('MOVIE_VIEWED', 3.0, 3, 1.2),
                              ('ADDED_TO_WATCHLIST', 2.0, 2, 0.8), ('MOVIE_CLICKED', 1.0, 1, 0.5),
                              ('SEARCHED_FOR_MOVIE', 0.5, 1, 0.5), ('UNKNOWN', 0.0, 1, 0.5)
        ) t(name, weight, k, multiplier)""",
    "events_named": """
        select i.eventId, i.userId, i.movieId, w.name as eventType, i.rating, i.tsMicros,
               w.weight, w.k, w.multiplier
        from interactions i join event_weights w
          on w.name = case when upper(replace(i.eventType, '-', '_')) in (select name from event_weights)
                           then upper(replace(i.eventType, '-', '_')) else 'UNKNOWN' end""",
    "item_near": """
        select itemId, otherId, cosine, row_number() over (partition by itemId order by cosine desc, otherId) as rank
        from (
            select a.itemId, b.itemId as otherId,
                   round(list_cosine_similarity(a.features, b.features), 9) as cosine
            from item_factors a cross join item_factors b
        ) p""",
    "processed": """
        select e.* from events_named e
        where weight > 0 and movieId is not null and userId in (select userId from user_factors)""",
    "event_recs": """
        select e.eventId, e.userId, e.movieId as seedMovieId, e.tsMicros, n.otherId as movieId,
               least(5.0, n.cosine * e.multiplier * 5) as score,
               row_number() over (partition by e.eventId order by n.rank) as position
        from processed e join item_near n on n.itemId = e.movieId and n.rank <= e.k
        where n.otherId <> e.movieId""",
    "messages": """
        select eventId, cast(userId as varchar) as key,
               '[' || string_agg('{"userId":' || userId || ',"movieId":' || movieId || ',"predictedRating":'
                   || cast(round(score, 4) as varchar) || ',"generatedAt":' || tsMicros || '}', ',' order by position)
               || ']' as value
        from event_recs group by eventId, userId""",
    "overview": """
        select count(*) as totalRows, count(ratingActual) as n,
               min(timestampEpochSeconds) as oldest, max(timestampEpochSeconds) as newest
        from ratings""",
    "recent": """
        select count(*) filter (where timestampEpochSeconds > newest - 30 * 86400) as r30,
               count(*) filter (where timestampEpochSeconds > newest - 7 * 86400) as r7,
               count(*) filter (where timestampEpochSeconds > newest - 86400) as r1,
               count(timestampEpochSeconds) as n
        from ratings cross join (select newest from overview) o""",
    "histogram": """
        select ratingActual, count(*) as n from ratings group by ratingActual""",
    "profile": """
        select userId, count(ratingActual) as totalRatings, avg(ratingActual) as avgRating,
               round(stddev_samp(ratingActual), 12) as ratingStdDev,
               count(distinct movieId) as uniqueMovies,
               min(timestampEpochSeconds) as minTimestamp, max(timestampEpochSeconds) as maxTimestamp,
               max(timestampEpochSeconds) - min(timestampEpochSeconds) as engagementSpan
        from ratings group by userId""",
    "labels_of": """
        select *,
               case when totalRatings > 100 then 'High' when totalRatings > 20 then 'Medium' else 'Low' end as activityLevel,
               case when avgRating > 4.0 then 'Positive' when avgRating > 2.5 then 'Neutral' else 'Critical' end as ratingPattern,
               case when uniqueMovies > totalRatings * 0.8::double then 'Explorer'
                    when uniqueMovies > totalRatings * 0.5::double then 'Selective' else 'Focused' end as engagementLevel,
               case when ratingStdDev < 0.5 then 'Consistent' when ratingStdDev < 1.0 then 'Moderate'
                    else 'Variable' end as ratingConsistency,
               case when totalRatings > 100 then 'VeryActive' when totalRatings > 50 then 'Active'
                    when totalRatings > 10 then 'Moderate' else 'Casual' end as ratingFrequency,
               case when uniqueMovies > totalRatings * 0.8::double then 'HighDiversity'
                    when uniqueMovies > totalRatings * 0.5::double then 'ModerateDiversity'
                    else 'LowDiversity' end as ratingDiversity
        from profile""",
    "calendar": """
        select userId, movieId, ratingActual, timestampEpochSeconds, moment,
               year(moment) as year, month(moment) as month, dayofweek(moment) + 1 as dayOfWeek, hour(moment) as hour
        from (select *, make_timestamp(timestampEpochSeconds * 1000000) as moment from ratings) r""",
    "performance": """
        select movieId, count(ratingActual) as totalRatings, avg(ratingActual) as avgRating,
               stddev_samp(ratingActual) as ratingStdDev, count(distinct userId) as uniqueRaters,
               min(ratingActual) as minRating, max(ratingActual) as maxRating
        from ratings group by movieId""",
    "top10": """
        select p.movieId, m.title, coalesce(m.genres, '(no genres listed)') as genres,
               p.totalRatings as ratingsCount, p.avgRating
        from performance p left join movies m on m.movieId = p.movieId
        order by p.totalRatings desc, p.movieId limit 10""",
    "top10_tags": """
        select * from (
            select movieId, tag, count(*) as tagCount,
                   row_number() over (partition by movieId order by count(*) desc, tag) as rank
            from tags where movieId in (select movieId from top10) group by movieId, tag
        ) t where rank <= 3""",
    "genre_agg": """
        select genre, count(*) as ratingCount, avg(ratingActual) as avgRating,
               count(distinct userId) as uniqueUsers, count(distinct r.movieId) as uniqueMovies,
               stddev_samp(ratingActual) as ratingStdDev
        from ratings r join movie_genres g on g.movieId = r.movieId group by genre""",
    "top_tags": """
        select tag, count(*) as tagCount, count(distinct movieId) as moviesTagged,
               count(distinct userId) as usersWhoTagged
        from tags group by tag order by tagCount desc, tag limit 20""",
    "sentiment": """
        select sum(pos) as positiveTags, sum(neg) as negativeTags from (
            select list_sum([cast(contains(lower(tag), w) as int) for w in
                       ['good','great','excellent','amazing','awesome','fantastic','wonderful','brilliant',
                        'outstanding','perfect']]) as pos,
                   list_sum([cast(contains(lower(tag), w) as int) for w in
                       ['bad','terrible','awful','horrible','worst','boring','stupid','disappointing',
                        'waste','sucks']]) as neg
            from tags) s""",
    "genre_tags": """
        select * from (
            select genre, tag, count(*) as tagCount,
                   row_number() over (partition by genre order by count(*) desc, tag) as rank
            from tags t join movie_genres g on g.movieId = t.movieId group by genre, tag
        ) t where rank <= 3""",
    "liked_tags": """
        select tag, avg(ratingActual) as avgRating, count(ratingActual) as ratingCount
        from tags t join ratings r on r.movieId = t.movieId and r.userId = t.userId
        group by tag having count(ratingActual) > 5 order by avg(ratingActual) desc, tag limit 10""",
}


def with_views(statement: str) -> str:
    """Put every view the statement uses, directly or through others, in front of it."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in VIEWS:
            if name not in needed and re.search(rf"\b{name}\b(?!\s*\()", sql) and name not in open_names:
                open_names.add(name)
                visit(VIEWS[name])
                needed.append(name)

    open_names: set[str] = set()
    visit(statement)
    if not needed:
        return statement
    clauses = ",\n".join(f"{name} as materialized ({VIEWS[name]})" for name in needed)
    return f"with {clauses}\n{statement}"
