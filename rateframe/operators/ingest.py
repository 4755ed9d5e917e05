"""Cleaning of raw ratings, movies and prediction pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rateframe.fixed_values import RATING_MAX, RATING_MIN
from rateframe.functions.expressions import genre_list

RAW_RATING_COLUMNS = ("userId", "movieId", "rating", "timestamp")


def one_row_per_movie(movies: DataFrame) -> DataFrame:
    """(movieId, title, genres); of several rows of one movie the one with the smallest title, then genres."""
    entry = F.min(F.struct(F.col("title").isNull(), "title", F.col("genres").isNull(), "genres")).alias("entry")
    return movies.groupBy("movieId").agg(entry).select("movieId", "entry.title", "entry.genres")


def conform_columns(df: DataFrame, expected: tuple[str, ...] = RAW_RATING_COLUMNS) -> DataFrame:
    """Pick the expected columns, matched by trimmed, case-insensitive name.

    The first match wins. When one is missing the result has the right columns and no rows.
    """
    found: dict[str, str] = {}
    for name in df.columns:
        found.setdefault(name.strip().lower(), name)
    wanted = [(name, found.get(name.strip().lower())) for name in expected]
    if any(actual is None for _, actual in wanted):
        return df.sparkSession.createDataFrame([], T.StructType([T.StructField(n, T.StringType()) for n in expected]))
    return df.select(*[F.col(f"`{actual}`").alias(name) for name, actual in wanted])


def _with_typed_values(raw: DataFrame) -> DataFrame:
    """The raw columns and, next to them, their trimmed and typed values; null where unreadable."""
    targets = {"_user": ("userId", "int"), "_movie": ("movieId", "int"), "_rating": ("rating", "double"), "_time": ("timestamp", "bigint")}
    kinds = dict(raw.dtypes)
    typed = [
        f"try_cast(trim({name}) as {kind}) as {alias}" if kinds[name] == "string" else f"cast({name} as {kind}) as {alias}"
        for alias, (name, kind) in targets.items()
    ]
    return raw.selectExpr(*raw.columns, *typed)


def _reject_reason() -> Column:
    missing = F.lit(False)
    for name in RAW_RATING_COLUMNS:
        missing = missing | F.col(name).isNull()
    in_range = F.col("_rating").between(RATING_MIN, RATING_MAX)
    return (
        F.when(missing, F.lit("MISSING_VALUE"))
        .when(F.col("_user").isNull(), F.lit("UNREADABLE_USER"))
        .when(F.col("_movie").isNull(), F.lit("UNREADABLE_MOVIE"))
        .when(F.col("_rating").isNull(), F.lit("UNREADABLE_RATING"))
        .when(F.col("_time").isNull(), F.lit("UNREADABLE_TIMESTAMP"))
        .when(F.col("_user") <= 0, F.lit("USER_NOT_POSITIVE"))
        .when(F.col("_movie") <= 0, F.lit("MOVIE_NOT_POSITIVE"))
        .when(~in_range, F.lit("RATING_OUT_OF_RANGE"))
    )


def clean_ratings(raw: DataFrame, strict: bool = False) -> DataFrame:
    """Typed ratings with every unusable row left out.

    ``strict`` makes the job fail on a row that has all cells but an unusable one,
    instead of leaving the row to :func:`quarantine_ratings`.
    """
    typed = _with_typed_values(raw)
    if strict:
        reason = _reject_reason()
        complaint = F.when(
            reason.isNotNull() & (reason != "MISSING_VALUE"),
            F.raise_error(F.concat(F.lit("unusable rating row: "), reason)).cast("boolean"),
        ).otherwise(reason.isNull())
        kept = typed.filter(complaint)
    else:
        kept = typed.filter(
            f"_user > 0 and _movie > 0 and _rating between {RATING_MIN}D and {RATING_MAX}D and _time is not null"
        )
    return kept.selectExpr(
        "_user as userId", "_movie as movieId", "_rating as ratingActual", "_time as timestampEpochSeconds"
    )


def quarantine_ratings(raw: DataFrame) -> DataFrame:
    """The rows :func:`clean_ratings` leaves out, as read, with the reason."""
    return (
        _with_typed_values(raw)
        .withColumn("reason", _reject_reason())
        .filter(F.col("reason").isNotNull())
        .select(*RAW_RATING_COLUMNS, "reason")
    )


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """Fail early when a step left nothing to work on; reads at most one row."""
    if df.isEmpty():
        raise ValueError(f"no {what}")
    return df


def typed_movies(raw: DataFrame) -> DataFrame:
    return raw.select(F.trim("movieId").try_cast("int").alias("movieId"), "title", "genres")


def typed_tags(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.trim("userId").try_cast("int").alias("userId"),
        F.trim("movieId").try_cast("int").alias("movieId"),
        "tag",
        F.trim("timestamp").try_cast("bigint").alias("timestamp"),
    )


def movie_genres_array(movies: DataFrame) -> DataFrame:
    return movies.select("movieId", "title", genre_list("genres").alias("genres"))


def movie_lookup_batch(movies: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row per wanted movieId: whether it is known and its metadata."""
    known = movie_genres_array(movies).withColumn("exists", F.lit(True))
    return (
        wanted.select("movieId")
        .distinct()
        .join(known, "movieId", "left")
        .select("movieId", F.coalesce("exists", F.lit(False)).alias("exists"), "title", "genres")
    )


def movie_count(movies: DataFrame) -> DataFrame:
    return movies.agg(F.count("*").alias("movies"))


def parse_prediction_pairs(lines: DataFrame) -> DataFrame:
    """(userId, movieId) from text lines; a header or any unreadable line is skipped."""
    cells = F.split(F.trim("value"), ",")
    return (
        lines.filter(F.size(cells) >= 2)
        .select(
            F.trim(cells[0]).try_cast("int").alias("userId"),
            F.trim(cells[1]).try_cast("int").alias("movieId"),
        )
        .dropna()
    )
