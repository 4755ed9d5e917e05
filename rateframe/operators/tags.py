"""What users say about movies through tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateframe.fixed_values import NEGATIVE_WORDS, POSITIVE_WORDS
from rateframe.functions.expressions import raw_genre_terms, share, sum_of
from rateframe.operators.bitmaps import counts_of, distinct_state


def tag_totals(tags: DataFrame) -> DataFrame:
    return tags.agg(
        F.count("*").alias("totalTags"),
        F.count_distinct("tag").alias("uniqueTags"),
        F.count_distinct("movieId").alias("uniqueTaggedMovies"),
        F.count_distinct("userId").alias("uniqueTaggingUsers"),
    ).select(
        "*",
        F.coalesce(share("totalTags", "uniqueTaggedMovies"), F.lit(0.0)).alias("avgTagsPerMovie"),
        F.coalesce(share("totalTags", "uniqueTaggingUsers"), F.lit(0.0)).alias("avgTagsPerUser"),
    )


def tag_counts(tags: DataFrame) -> DataFrame:
    """Uses per distinct tag: the base of popularity and sentiment."""
    return tags.groupBy("tag").agg(F.count("*").alias("uses"))


def popular_tags(tags: DataFrame, counts: DataFrame, k: int = 20) -> DataFrame:
    """The k most used tags. Distinct movies and users are counted for those k only."""
    top = (
        counts.filter(F.col("tag").isNotNull())
        .select(F.col("tag").alias("topTag"), F.col("uses").alias("tagCount"))
        .orderBy(F.desc("tagCount"), "topTag")
        .limit(k)
    )
    ids = ("movieId", "userId")
    used = tags.join(F.broadcast(top), F.col("tag") == F.col("topTag")).select("tag", *ids)
    found = counts_of(distinct_state(used, "tag", ids), ids)
    return found.join(F.broadcast(top), F.col("part") == F.col("topTag")).select(
        F.col("part").alias("tag"), "tagCount", F.col("movieId").alias("moviesTagged"), F.col("userId").alias("usersWhoTagged")
    )


def _mentions(words: tuple[str, ...]) -> Column:
    lowered = F.lower("tag")
    return F.coalesce(sum_of(lowered.contains(w).cast("int") for w in words), F.lit(0))


def tag_sentiment(counts: DataFrame) -> DataFrame:
    """Positive and negative word hits over all tags; a tag counts once per word it contains."""
    positive, negative = F.col("positiveTags"), F.col("negativeTags")
    return (
        counts.agg(
            F.coalesce(F.sum(F.col("uses") * _mentions(POSITIVE_WORDS)), F.lit(0)).alias("positiveTags"),
            F.coalesce(F.sum(F.col("uses") * _mentions(NEGATIVE_WORDS)), F.lit(0)).alias("negativeTags"),
        )
        .withColumn(
            "sentimentRatio",
            F.when(negative > 0, share(positive, negative))
            .when(positive > 0, F.lit(float("inf")))
            .otherwise(F.lit(0.0)),
        )
    )


def genre_top_tags(tags: DataFrame, movies: DataFrame, k: int = 3) -> DataFrame:
    """The k most used tags of each genre; tags are folded per movie before the join."""
    most_used = Window.partitionBy("genre").orderBy(F.desc("tagCount"), "tag")
    return (
        tags.groupBy("movieId", "tag")
        .agg(F.count("*").alias("n"))
        .join(movies.select("movieId", raw_genre_terms("genres").alias("terms")), "movieId")
        .select("tag", "n", F.explode("terms").alias("genre"))
        .groupBy("genre", "tag")
        .agg(F.sum("n").alias("tagCount"))
        .withColumn("rank", F.row_number().over(most_used))
        .filter(F.col("rank") <= k)
    )


def tag_rating_affinity(tags: DataFrame, pairs: DataFrame, k: int = 10, more_than: int = 5) -> DataFrame:
    """Mean rating that taggers gave what they tagged, for tags with enough ratings.

    Ratings arrive folded per (movie, user) and tags are folded here, so repeated tags and
    ratings multiply as numbers and not as joined rows.
    """
    used = tags.groupBy("movieId", "userId", "tag").agg(F.count("*").alias("uses"))
    return affinity_of(used.join(pairs.select("movieId", "userId", "n", "total"), ["movieId", "userId"]), k, more_than)


def tagged_pairs(tags: DataFrame, pairs: DataFrame) -> DataFrame:
    """Uses per (movie, user, tag) with the folded ratings of the pair, where it has any (``rated``): the base of the two
    reports that bring tags and ratings together."""
    used = tags.groupBy("movieId", "userId", "tag").agg(F.count("*").alias("uses"))
    rated = pairs.select("movieId", "userId", "n", "total", F.lit(True).alias("rated"))
    return used.join(rated, ["movieId", "userId"], "left")


def affinity_of(rated_tags: DataFrame, k: int = 10, more_than: int = 5) -> DataFrame:
    """:func:`tag_rating_affinity` of folded tags (tag, uses) with the ratings (n, total) of their pair."""
    return (
        rated_tags.groupBy("tag")
        .agg(
            F.sum(F.col("uses") * F.col("n")).alias("ratingCount"),
            F.sum(F.col("uses") * F.col("total")).alias("total"),
        )
        .filter(F.col("ratingCount") > more_than)
        .select("tag", (F.col("total") / F.col("ratingCount")).alias("avgRating"), "ratingCount")
        .orderBy(F.desc("avgRating"), "tag")
        .limit(k)
    )
