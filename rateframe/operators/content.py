"""Movie popularity, genres and content performance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateframe.fixed_values import NO_GENRE
from rateframe.functions.expressions import count_where, raw_genre_terms
from rateframe.operators.bitmaps import counts_of, distinct_state
from rateframe.operators.facts import folded, mean, sample_stddev
from rateframe.operators.ingest import one_row_per_movie


def movie_facts(pairs: DataFrame) -> DataFrame:
    """Sums, distinct raters and extremes per movie, out of pair facts."""
    return pairs.groupBy("movieId").agg(
        F.sum("rows").alias("rows"),
        *folded(),
        F.count("*").alias("raters"),
        F.min("minRating").alias("minRating"),
        F.max("maxRating").alias("maxRating"),
    )


def movie_performance(facts: DataFrame) -> DataFrame:
    """Count, mean, deviation, distinct raters and extremes per movie."""
    return facts.select(
        "movieId",
        F.col("n").alias("totalRatings"),
        mean().alias("avgRating"),
        sample_stddev().alias("ratingStdDev"),
        F.col("raters").alias("uniqueRaters"),
        "minRating",
        "maxRating",
    )


def performance_overview(performance: DataFrame) -> DataFrame:
    """One pass over the movies, one row: what the summaries below pick from."""
    n = F.col("totalRatings")
    return performance.agg(
        F.count("movieId").alias("movies"),
        F.avg(n).alias("avgRatings"),
        F.min(n).alias("minRatings"),
        F.max(n).alias("maxRatings"),
        F.percentile_approx(n, 0.5).alias("medianRatings"),
        F.avg("avgRating").alias("avgAvgRating"),
        F.avg("ratingStdDev").alias("avgStdDev"),
        F.avg("uniqueRaters").alias("avgRaters"),
        count_where(F.col("avgRating") > 4.0).alias("above4"),
        count_where(F.col("avgRating") < 2.5).alias("below2_5"),
        count_where(F.col("ratingStdDev") > 1.5).alias("polarizing"),
    )


def movie_popularity(performance: DataFrame, movies: DataFrame) -> DataFrame:
    """One row per rated movie with its metadata; ratings are folded before the join."""
    return performance.join(one_row_per_movie(movies), "movieId", "left").select(
        "movieId",
        "title",
        "genres",
        F.col("totalRatings").alias("ratingsCount"),
        "avgRating",
        "ratingStdDev",
    )


def movie_popularity_summary(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("movies").alias("totalMovies"),
        F.col("avgRatings").alias("avgRatingsPerMovie"),
        F.col("minRatings").alias("minRatingsPerMovie"),
        F.col("maxRatings").alias("maxRatingsPerMovie"),
        F.col("medianRatings").alias("medianRatingsPerMovie"),
        F.col("avgAvgRating").alias("overallAvgRating"),
    )


def top_movies(popularity: DataFrame, k: int = 10) -> DataFrame:
    return (
        popularity.orderBy(F.desc("ratingsCount"), "movieId")
        .limit(k)
        .select(
            "movieId",
            "title",
            F.coalesce("genres", F.lit(NO_GENRE)).alias("genres"),
            "ratingsCount",
            "avgRating",
        )
    )


def top_movie_tags(top: DataFrame, tags: DataFrame, k: int = 3) -> DataFrame:
    """The k most used tags of each top movie. ``top`` has a fixed, small number of rows."""
    most_used = Window.partitionBy("movieId").orderBy(F.desc("tagCount"), "tag")
    return (
        tags.join(F.broadcast(top.select("movieId")), "movieId")
        .groupBy("movieId", "tag")
        .agg(F.count("*").alias("tagCount"))
        .withColumn("rank", F.row_number().over(most_used))
        .filter(F.col("rank") <= k)
    )


def _movie_genres(movies: DataFrame) -> DataFrame:
    return movies.select("movieId", raw_genre_terms("genres").alias("terms"))


GENRE_IDS, GENRE_SUMS = ("userId", "movieId"), ("n", "total", "totalSquares")


def genre_state(rows: DataFrame, movies: DataFrame) -> DataFrame:
    """Bitmaps of users and movies, and sums, per genre, out of pair facts or single ratings. States of several batches merge."""
    spread = rows.join(_movie_genres(movies), "movieId").select(*GENRE_IDS, *GENRE_SUMS, F.explode("terms").alias("genre"))
    return distinct_state(spread, "genre", GENRE_IDS, GENRE_SUMS)


def genre_stats_of(state: DataFrame) -> DataFrame:
    """Count, mean, deviation, distinct users and movies per genre."""
    counts = counts_of(state, GENRE_IDS, GENRE_SUMS).withColumn("n", F.col("n").cast("bigint"))
    return counts.select(
        F.col("part").alias("genre"),
        F.col("n").alias("ratingCount"),
        mean().alias("avgRating"),
        F.col("userId").alias("uniqueUsers"),
        F.col("movieId").alias("uniqueMovies"),
        sample_stddev().alias("ratingStdDev"),
    )


def genre_stats(rows: DataFrame, movies: DataFrame) -> DataFrame:
    """In one pass over pair facts or single ratings, of which no row is dealt by user or movie to be counted."""
    return genre_stats_of(genre_state(rows, movies))


def genre_stats_of_facts(pairs: DataFrame, movie_facts: DataFrame, movies: DataFrame) -> DataFrame:
    """The same where both folds are stored: sums and movies come from the movie facts, only users from the pairs."""
    genres = _movie_genres(movies)
    users = pairs.select("userId", "movieId").join(genres, "movieId").select("userId", F.explode("terms").alias("genre"))
    raters = counts_of(distinct_state(users, "genre", ("userId",)), ("userId",)).select(F.col("part").alias("genre"), "userId")
    rated = movie_facts.join(genres, "movieId").select("movieId", *GENRE_SUMS, F.explode("terms").alias("genre"))
    sums = rated.groupBy("genre").agg(F.count_distinct("movieId").alias("movieId"), *folded())
    return sums.join(raters, sums["genre"].eqNullSafe(raters["genre"]), "left").select(
        sums["genre"],
        F.coalesce("n", F.lit(0)).alias("ratingCount"),
        mean().alias("avgRating"),
        F.coalesce("userId", F.lit(0)).alias("uniqueUsers"),
        F.col("movieId").alias("uniqueMovies"),
        sample_stddev().alias("ratingStdDev"),
    )


def genre_extremes(stats: DataFrame) -> DataFrame:
    """Most and least rated, best and worst rated genre; the first by name wins a tie."""
    genre, n, mean = F.col("genre"), F.col("ratingCount"), F.col("avgRating")
    return (
        stats.agg(
            F.count("*").alias("totalGenres"),
            F.min(F.struct(-n, genre)).alias("most"),
            F.min(F.struct(n, genre)).alias("least"),
            F.min(F.struct(-mean, genre)).alias("best"),
            F.min(F.struct(mean, genre)).alias("worst"),
        )
        .select(
            "totalGenres",
            F.col("most.genre").alias("mostPopularGenre"),
            (-F.col("most.col1")).alias("mostPopularGenreCount"),
            F.col("least.genre").alias("leastPopularGenre"),
            F.col("least.ratingCount").alias("leastPopularGenreCount"),
            F.col("best.genre").alias("bestRatedGenre"),
            (-F.col("best.col1")).alias("bestRatedGenreAvg"),
            F.col("worst.genre").alias("worstRatedGenre"),
            F.col("worst.avgRating").alias("worstRatedGenreAvg"),
        )
    )


def genre_fallback(over: DataFrame) -> DataFrame:
    """What can be said without movie metadata."""
    return over.select(
        F.col("movies").alias("totalMovies"),
        F.col("avgRatings").alias("avgRatingsPerMovie"),
        F.col("avgAvgRating").alias("avgMovieRating"),
    )


def content_performance_summary(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("movies").alias("totalMovies"),
        F.col("avgRatings").alias("avgRatingsPerMovie"),
        F.col("avgAvgRating").alias("overallAvgRating"),
        F.coalesce("avgStdDev", F.lit(0.0)).alias("avgRatingVariability"),
        F.col("avgRaters").alias("avgUniqueRatersPerMovie"),
    )


def content_performance_flags(over: DataFrame) -> DataFrame:
    return over.select(
        F.col("above4").alias("highRatedMovies"),
        F.col("below2_5").alias("lowRatedMovies"),
        F.col("polarizing").alias("polarizingMovies"),
    )
