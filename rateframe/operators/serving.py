"""Stored recommendation documents: building, storing and looking them up.

A document is (userId, recommendations, generatedAt, modelVersion); recommendations are
structs, best first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.functions.expressions import genre_list
from rateframe.operators.documents import keep_latest, upsert_counts
from rateframe.operators.ingest import one_row_per_movie

MAX_TOP_N = 10
MAX_BATCH = 100


def _best_first(a: Column, b: Column) -> Column:
    return (
        F.when(a["rating"] > b["rating"], -1)
        .when(a["rating"] < b["rating"], 1)
        .when(a["movieId"] < b["movieId"], -1)
        .when(a["movieId"] > b["movieId"], 1)
        .otherwise(0)
    )


def group_recommendations(rows: DataFrame) -> DataFrame:
    """(userId, movieId, rating) rows of a top list to one array per user, as long as the list was."""
    entry = F.struct("movieId", "rating")
    return rows.groupBy("userId").agg(F.collect_list(entry).alias("recommendations"))


def recs_enriched(
    recommended: DataFrame, movies: DataFrame | None, generated_at: int, model_version: str
) -> DataFrame:
    """Recommendation documents with title and genres, sorted by rating.

    Lists are as long as the model's top-k, so regrouping one user's rows is bounded.
    """
    rows = recommended.select("userId", F.explode("recommendations").alias("rec")).select(
        "userId", "rec.movieId", "rec.rating"
    )
    if movies is None:
        titled = rows.select("*", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("genres"))
    else:
        titled = rows.join(one_row_per_movie(movies), "movieId", "left")
    genres = F.when(F.col("title").isNotNull(), genre_list("genres"))
    entry = F.struct(
        "movieId", "rating", "title", genres.alias("genres"), F.lit(generated_at).cast("bigint").alias("generatedAt")
    )
    return (
        titled.groupBy("userId")
        .agg(F.array_sort(F.collect_list(entry), _best_first).alias("recommendations"))
        .select(
            "userId",
            "recommendations",
            F.lit(generated_at).cast("bigint").alias("generatedAt"),
            F.lit(model_version).alias("modelVersion"),
        )
    )


def recs_upsert(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Each incoming document replaces its user's stored one."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)))
    return keep_latest(both, "userId", F.desc("_new"), F.desc("generatedAt")).drop("_new")


def recs_upsert_counts(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return upsert_counts(existing, incoming, "userId")


def _with_total(documents: DataFrame) -> DataFrame:
    return documents.withColumn("totalRecommendations", F.size("recommendations"))


def first_n(documents: DataFrame, n: int | None) -> DataFrame:
    if n is None:
        return _with_total(documents)
    return _with_total(documents.withColumn("recommendations", F.slice("recommendations", 1, n)))


def _of(documents: DataFrame, who: int | DataFrame) -> DataFrame:
    """Documents of one user, or of every user in a table with a userId column."""
    if isinstance(who, DataFrame):
        return documents.join(who.select("userId").distinct(), "userId", "left_semi")
    return documents.filter(F.col("userId") == who)


def recs_by_user(documents: DataFrame, who: int | DataFrame) -> DataFrame:
    return _with_total(_of(documents, who))


def recs_by_user_topn(documents: DataFrame, who: int | DataFrame, n: int) -> DataFrame:
    if not 1 <= n <= MAX_TOP_N:
        raise ValueError(f"n must be between 1 and {MAX_TOP_N}: {n}")
    return first_n(_of(documents, who), n)


def parse_user_ids(text: str) -> list[int]:
    """Comma-separated ids with optional blanks."""
    try:
        return [int(part.strip()) for part in text.split(",")]
    except ValueError as error:
        raise ValueError(f"not a list of user ids: {text!r}") from error


def recs_batch(documents: DataFrame, user_ids: Sequence[int], limit: int | None = None) -> DataFrame:
    """Documents of the given users; users without one are absent."""
    if not user_ids:
        raise ValueError("no user ids given")
    if len(user_ids) > MAX_BATCH:
        raise ValueError(f"at most {MAX_BATCH} user ids, got {len(user_ids)}")
    if limit is not None and limit <= 0:
        raise ValueError(f"limit must be positive: {limit}")
    return first_n(documents.filter(F.col("userId").isin(*user_ids)), limit)


def recs_exists(documents: DataFrame, users: DataFrame) -> DataFrame:
    """Every given user and whether a document is stored for them."""
    stored = documents.select("userId").distinct().withColumn("exists", F.lit(True))
    return (
        users.select("userId")
        .distinct()
        .join(stored, "userId", "left")
        .select("userId", F.coalesce("exists", F.lit(False)).alias("exists"))
    )
