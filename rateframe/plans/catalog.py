"""Every named query over the given tables.

A query takes (spark, folder of tables) and returns flat rows: arrays and maps are unnested and
floats rounded, so that any SQL engine can state the same result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateframe.functions.expressions import round_doubles, sum_of, vector_problem
from rateframe.operators import (
    als,
    charts,
    content,
    distribution,
    documents,
    ingest,
    platform,
    quality,
    serving,
    tags as tag_ops,
    temporal,
    users,
    vector_index,
    vectors,
)
from rateframe.plans import analytics_job, collectors
from rateframe.plans.collectors import Inputs
from rateframe.session import fresh_path, materialize, use_utc
from rateframe.sources import derived_inputs as src
from rateframe.sources import files, keyed_store
from rateframe.streaming import realtime

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Epoch seconds that count as now: one inside the data's time span, one 71 days after it.
QUALITY_AS_OF = 1001894400
FRESHNESS_AS_OF = 1011052800
# Where "earlier" and "later" stored documents part, and when recommendations were generated.
RATINGS_CUT = 946684800
DOCS_CUT_MICROS = 1704672000000000
GENERATED_AT = 1700000000000000
CHART_GENRE_MORE_THAN = 5000
TOP_K = 5
USER_SCORE_WEIGHT = 3.0
ALS_CONFIG = als.AlsConfig(rank=10, max_iter=5, reg_param=0.2, seed=42, train_share=0.7)


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return round_doubles(build(use_utc(spark), sf_dir))

    QUERIES[build.__name__] = run
    return run


def _inputs(spark: SparkSession, d: str, as_of: int = FRESHNESS_AS_OF) -> Inputs:
    return Inputs(src.ratings(spark, d), src.movies(spark, d), src.tags(spark, d), as_of)


def _rated(spark: SparkSession, d: str, as_of: int = FRESHNESS_AS_OF) -> Inputs:
    """Inputs for reports that need nothing but ratings."""
    return Inputs(src.ratings(spark, d), None, None, as_of)


def _raw_seen(spark: SparkSession, d: str) -> DataFrame:
    return quality.overview(src.typed_raw_ratings(spark, d), QUALITY_AS_OF)


# --- ingest and cleaning ----------------------------------------------------------

def _as_csv(df: DataFrame, label: str) -> str:
    path = fresh_path(df.sparkSession, label)
    files.write_csv(df, path)
    return path


@query
def ingest_ratings(spark, d):
    return files.load_raw_ratings(spark, _as_csv(src.raw_ratings(spark, d), "ratings-csv"))


@query
def ingest_movies(spark, d):
    return files.load_movies(spark, _as_csv(src.movies(spark, d), "movies-csv"))


@query
def ingest_tags(spark, d):
    return files.load_tags(spark, _as_csv(src.tags(spark, d), "tags-csv"))


@query
def conform_columns(spark, d):
    strange = src.raw_ratings(spark, d).select(
        F.col("timestamp").alias(" TimeStamp "),
        F.lit("x").alias("other"),
        F.col("movieId").alias("MOVIEID"),
        F.col("userId").alias(" userid"),
        F.col("rating").alias("Rating"),
    )
    return ingest.conform_columns(strange)


@query
def clean_ratings(spark, d):
    return ingest.clean_ratings(src.raw_ratings(spark, d))


@query
def quarantine_ratings(spark, d):
    return ingest.quarantine_ratings(src.raw_ratings(spark, d))


@query
def movie_genres_array(spark, d):
    return ingest.movie_genres_array(src.movies(spark, d)).select(
        "movieId", "title", F.size("genres").alias("genreCount"), F.array_join("genres", ";").alias("genreNames")
    )


@query
def movie_lookup_batch(spark, d):
    movies = src.movies(spark, d)
    wanted = src.interactions(spark, d).filter(F.col("movieId").isNotNull())
    return ingest.movie_lookup_batch(movies, wanted).select(
        "movieId",
        "exists",
        "title",
        F.array_join("genres", ";").alias("genreNames"),
        ingest.movie_count(movies).scalar().alias("movieCount"),
    )


@query
def prediction_pairs(spark, d):
    event = src.interactions(spark, d)
    line = F.concat_ws(
        ",",
        F.col("userId").cast("string"),
        F.when(F.col("movieId").isNull(), "movieId").otherwise(F.concat(F.lit(" "), F.col("movieId").cast("string"))),
    )
    path = fresh_path(spark, "pairs")
    event.select(line.alias("value")).write.text(path)
    return files.load_prediction_pairs(spark, path)


# --- data quality and freshness ------------------------------------------------------

@query
def dq_completeness(spark, d):
    return quality.dq_completeness(_raw_seen(spark, d))


@query
def dq_duplicates(spark, d):
    return quality.dq_duplicates(src.typed_raw_ratings(spark, d))


@query
def dq_freshness(spark, d):
    return quality.dq_freshness(quality.recency(src.ratings(spark, d)))


@query
def dq_rating_range(spark, d):
    return quality.dq_rating_range(distribution.rating_histogram(src.typed_raw_ratings(spark, d)))


@query
def dq_orphan_ratings(spark, d):
    return quality.dq_orphan_ratings(_rated(spark, d).movie_facts, src.movies(spark, d))


@query
def dq_orphan_tags(spark, d):
    return quality.dq_orphan_tags(src.tags(spark, d), _rated(spark, d).pairs)


@query
def dq_timestamps(spark, d):
    return quality.dq_timestamps(_raw_seen(spark, d))


@query
def dq_consistency_score(spark, d):
    return quality.dq_consistency_score(_raw_seen(spark, d))


@query
def freshness_span(spark, d):
    return quality.freshness_span(_rated(spark, d).seen)


@query
def freshness_recent(spark, d):
    return _rated(spark, d).recent


@query
def freshness_score(spark, d):
    return quality.freshness_score(_rated(spark, d).seen, FRESHNESS_AS_OF)


@query
def freshness_trend(spark, d):
    return quality.freshness_trend(_rated(spark, d).recent)


# --- rating distribution -----------------------------------------------------------------

@query
def rating_histogram(spark, d):
    return _rated(spark, d).histogram.orderBy("ratingActual")


@query
def rating_stats(spark, d):
    return distribution.rating_stats(_rated(spark, d).seen)


@query
def rating_bands(spark, d):
    return distribution.rating_bands(_rated(spark, d).seen)


@query
def rating_mode(spark, d):
    return distribution.rating_mode(_rated(spark, d).histogram)


@query
def rating_quartiles(spark, d):
    return distribution.rating_quartiles(_rated(spark, d).histogram)


# --- users ------------------------------------------------------------------------------------

@query
def user_profile(spark, d):
    return _rated(spark, d).profile


@query
def top_users(spark, d):
    return users.top_users(_rated(spark, d).profile)


@query
def user_activity_summary(spark, d):
    return users.user_activity_summary(_rated(spark, d).users_seen)


@query
def user_engagement_summary(spark, d):
    return users.user_engagement_summary(_rated(spark, d).users_seen)


@query
def engagement_tiers(spark, d):
    return users.engagement_tiers(_rated(spark, d).users_seen)


@query
def activity_levels(spark, d):
    return users.activity_levels(_rated(spark, d).users_seen)


@query
def segment_variation(spark, d):
    return users.segment_variation(_rated(spark, d).users_seen)


@query
def segmentation_score(spark, d):
    return users.segmentation_score(_rated(spark, d).users_seen)


@query
def engagement_quality(spark, d):
    return users.engagement_quality(_rated(spark, d).users_seen)


@query
def engagement_consistency(spark, d):
    return users.engagement_consistency(_rated(spark, d).users_seen)


@query
def segment_matrix(spark, d):
    return users.segment_matrix(_rated(spark, d).segments)


@query
def advanced_segments(spark, d):
    return users.advanced_segments(_rated(spark, d).segments)


@query
def rating_behavior_matrix(spark, d):
    return users.rating_behavior_matrix(_rated(spark, d).segments)


# --- temporal trends --------------------------------------------------------------------------

@query
def calendar_features(spark, d):
    return temporal.calendar_features(src.ratings(spark, d))


@query
def yearly_trends(spark, d):
    return temporal.yearly_trends(_rated(spark, d).calendar).orderBy("year")


@query
def monthly_trends(spark, d):
    return temporal.monthly_trends(_rated(spark, d).cube).orderBy("month")


@query
def weekday_trends(spark, d):
    return temporal.weekday_trends(_rated(spark, d).cube).orderBy("dayOfWeek")


@query
def top_hours(spark, d):
    return temporal.top_hours(_rated(spark, d).cube)


# --- content --------------------------------------------------------------------------------------

@query
def movie_popularity(spark, d):
    return _inputs(spark, d).popularity


@query
def movie_popularity_summary(spark, d):
    return content.movie_popularity_summary(_rated(spark, d).movies_seen)


@query
def top_movies(spark, d):
    return _inputs(spark, d).top


@query
def top_movie_tags(spark, d):
    data = _inputs(spark, d)
    return content.top_movie_tags(data.top, data.tags)


@query
def genre_stats(spark, d):
    return _inputs(spark, d).genres


@query
def genre_extremes(spark, d):
    return content.genre_extremes(_inputs(spark, d).genres)


@query
def genre_fallback(spark, d):
    return content.genre_fallback(_rated(spark, d).movies_seen)


@query
def movie_performance(spark, d):
    return _rated(spark, d).performance


@query
def content_performance_summary(spark, d):
    return content.content_performance_summary(_rated(spark, d).movies_seen)


@query
def content_performance_flags(spark, d):
    return content.content_performance_flags(_rated(spark, d).movies_seen)


# --- tags ---------------------------------------------------------------------------------------------

@query
def tag_totals(spark, d):
    return tag_ops.tag_totals(src.tags(spark, d))


@query
def popular_tags(spark, d):
    data = _inputs(spark, d)
    return tag_ops.popular_tags(data.tags, data.tag_counts)


@query
def tag_sentiment(spark, d):
    return tag_ops.tag_sentiment(_inputs(spark, d).tag_counts)


@query
def genre_top_tags(spark, d):
    return tag_ops.genre_top_tags(src.tags(spark, d), src.movies(spark, d))


@query
def tag_rating_affinity(spark, d):
    return tag_ops.tag_rating_affinity(src.tags(spark, d), _rated(spark, d).pairs)


# --- data platform ----------------------------------------------------------------------------------------

@query
def dataset_sizes(spark, d):
    data = _inputs(spark, d)
    return platform.dataset_sizes(data.ratings, data.movies, data.tags)


@query
def null_records(spark, d):
    return platform.null_records(_raw_seen(spark, d))


@query
def valid_row_ratio(spark, d):
    return platform.valid_row_ratio(_raw_seen(spark, d))


@query
def user_skew(spark, d):
    return platform.user_skew(_rated(spark, d).profile)


@query
def partition_profile(spark, d):
    """Rows are SQL's; how they lie in partitions is the cluster's, so that is held against itself."""
    whole = F.col("avgRecordsPerPartition") * F.col("partitionCount")
    well = F.col("avgRecordsPerPartition").between(1000, 100000)
    return platform.partition_profile(src.ratings(spark, d)).select(
        "totalRecords",
        "estimatedMemoryUsageBytes",
        (F.abs(whole - F.col("totalRecords")) < 1e-3).alias("averageTimesPartitions"),
        (F.col("avgRecordsPerPartition").between(F.col("minRecordsPerPartition"), F.col("maxRecordsPerPartition"))).alias("averageBetweenEnds"),
        (well == F.col("isWellPartitioned")).alias("flagFollowsAverage"),
    )


@query
def run_timing(spark, d):
    """Rows are SQL's; times are the clock's, so what follows from them is held against them."""
    speed = F.col("totalRecords") * 1000 / F.greatest(F.col("processingTimeMs"), F.lit(1))
    label = F.when(speed > 1000, "High").when(speed > 100, "Medium").otherwise("Low")
    score = F.when(F.col("qualityCheckTimeMs") > 5000, 90.0).otherwise(100.0)  # all ratings are complete
    return platform.run_timing(src.ratings(spark, d)).select(
        "totalRecords",
        (F.col("processingTimeMs") > 0).alias("runTook"),
        (F.col("qualityCheckTimeMs") > 0).alias("checkTook"),
        (F.abs(F.col("recordsPerSecond") - speed) <= speed * 1e-9).alias("speedFollowsTime"),
        (F.col("processingEfficiency") == label).alias("labelFollowsSpeed"),
        (F.col("processingEfficiencyScore") == score).alias("scoreFollowsCheck"),
    )


# --- analytics documents ----------------------------------------------------------------------------------------

def _metrics_of(data: Inputs, collect: Callable[[Inputs], DataFrame]) -> DataFrame:
    return collect(data.store())


def _all_metrics(spark: SparkSession, d: str) -> DataFrame:
    """All collectors, without what differs from run to run."""
    data = _inputs(spark, d).store()
    parts = [c.collect(data) for c in collectors.COLLECTORS if c.name != "SYSTEM_PERFORMANCE"]
    return collectors.union_all([*parts, collectors.system_performance(data, run_dependent=False)])


@query
def analytics_metrics_long(spark, d):
    return _all_metrics(spark, d).drop("seq")


@query
def analytics_documents(spark, d):
    docs = documents.analytics_documents(_all_metrics(spark, d), "run1", GENERATED_AT)
    return docs.select(
        "analyticsId", "generatedAtMicros", "collector", "type", "category", "description",
        F.explode("metrics").alias("metric_key", "value"),
    ).select("*", "value.*").drop("value")


@query
def analytics_run_status(spark, d):
    statuses, _ = analytics_job.run_collectors(_inputs(spark, d).store(), "run1", GENERATED_AT)
    return statuses


def _document_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Earlier and later versions of documents that share an id per type and description."""
    docs = src.analytics_docs(spark, d).withColumn("analyticsId", F.concat_ws("|", "type", "description"))
    return docs.filter(F.col("generatedAtMicros") < DOCS_CUT_MICROS), docs.filter(
        F.col("generatedAtMicros") >= DOCS_CUT_MICROS
    )


def _stored(key: str, merge: keyed_store.Merge, *batches: DataFrame) -> DataFrame:
    """What a store holds after upserts of the batches."""
    store = keyed_store.KeyedStore(batches[0].sparkSession, fresh_path(batches[0].sparkSession, f"store-{key}"), key)
    for batch in batches:
        store.upsert(batch, merge)
    return store.read()


@query
def analytics_upsert(spark, d):
    return _stored("analyticsId", documents.analytics_upsert, *_document_versions(spark, d))


DOCUMENT_QUERIES = {
    "id": {"analytics_id": "doc_10"},
    "types_and_dates": {
        "types": ["DATA_QUALITY", "USER_ACTIVITY"],
        "from_micros": 1704153600000000,
        "to_micros": 1706745600000000,
        "sort_by": "analyticsId",
        "ascending": True,
        "page": 1,
        "size": 10,
    },
    "types": {"types": ["MOVIE_POPULARITY", "MYSTERY_TYPE"], "keyword": "no match, and not looked at", "page": 2},
    "since": {"from_micros": 1705000000000000, "ascending": True, "size": 7},
    "until": {"to_micros": 1705000000000000},
    "keyword": {"keyword": "PURCHASE by user 1", "sort_by": "description", "size": 15},
    "all": {"size": 100},
    "beyond_last_page": {"page": 1000000},
}
SORTING = ("sort_by", "ascending")


@query
def analytics_query(spark, d):
    docs = src.analytics_docs(spark, d)
    return collectors.union_all([
        documents.analytics_query(docs, **wanted).select(
            F.lit(case).alias("case"), "analyticsId", "generatedAtMicros", "type", "description"
        )
        for case, wanted in DOCUMENT_QUERIES.items()
    ])


@query
def analytics_count(spark, d):
    docs = src.analytics_docs(spark, d)
    return collectors.union_all([
        documents.analytics_count(docs, **{k: v for k, v in wanted.items() if k not in SORTING}).select(
            F.lit(case).alias("case"), "*"
        )
        for case, wanted in DOCUMENT_QUERIES.items()
    ])


@query
def analytics_by_id(spark, d):
    return documents.analytics_by_id(src.analytics_docs(spark, d), "doc_16")


@query
def analytics_counts_by_type(spark, d):
    return documents.analytics_counts_by_type(src.analytics_docs(spark, d))


@query
def analytics_counts_by_category(spark, d):
    return documents.analytics_counts_by_category(
        documents.analytics_counts_by_type(src.analytics_docs(spark, d))
    )


@query
def analytics_summary(spark, d):
    return documents.analytics_summary(src.analytics_docs(spark, d))


@query
def analytics_exists_by_type(spark, d):
    return documents.analytics_exists_by_type(src.analytics_docs(spark, d))


@query
def analytics_latest_by_type(spark, d):
    return documents.analytics_latest_by_type(src.analytics_docs(spark, d))


@query
def analytics_type_catalog(spark, d):
    """The catalog next to how many stored documents each type has."""
    counts = src.analytics_docs(spark, d).groupBy("type").agg(F.count("*").alias("n"))
    return (
        documents.analytics_type_catalog(spark)
        .join(counts, "type", "left")
        .withColumn("documents", F.coalesce("n", F.lit(0)))
        .drop("n")
    )


# --- charts -----------------------------------------------------------------------------------------------------------

@query
def chart_rating_distribution(spark, d):
    return charts.chart_rating_distribution(_metrics_of(_rated(spark, d), collectors.rating_distribution))


@query
def chart_engagement(spark, d):
    return charts.chart_engagement(_metrics_of(_rated(spark, d), collectors.user_engagement))


@query
def chart_segmentation(spark, d):
    return charts.chart_segmentation(_metrics_of(_rated(spark, d), collectors.user_segmentation))


@query
def chart_top_movies(spark, d):
    return charts.chart_top_movies(_metrics_of(_inputs(spark, d), collectors.movie_popularity))


@query
def chart_genre_popularity(spark, d):
    return charts.chart_genre_popularity(_metrics_of(_inputs(spark, d), collectors.genre_distribution))


@query
def chart_genre_quality(spark, d):
    return charts.chart_genre_quality(_metrics_of(_inputs(spark, d), collectors.genre_distribution), CHART_GENRE_MORE_THAN)


@query
def chart_monthly(spark, d):
    return charts.chart_monthly(_metrics_of(_rated(spark, d), collectors.temporal_trends))


@query
def chart_yearly(spark, d):
    return charts.chart_yearly(_metrics_of(_rated(spark, d), collectors.temporal_trends))


@query
def chart_weekly(spark, d):
    return charts.chart_weekly(_metrics_of(_rated(spark, d), collectors.temporal_trends))


@query
def metric_numeric_value(spark, d):
    key, value = F.col("event_id"), F.col("value")
    raw = (
        F.when(key % 5 == 0, F.format_string('{"$numberLong": "%d"}', key * 1000))
        .when(
            key % 5 == 1,
            F.concat(F.lit('{"$date": "'), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('Z"}')),
        )
        .when(key % 5 == 2, value.cast("string"))
        .when(key % 5 == 3, F.concat(F.lit('"'), F.col("event_type"), F.lit('"')))
    )
    stored = src.given(spark, d, "events").select(key.alias("eventId"), raw.alias("raw"))
    return charts.metric_numeric_value(stored)


# --- collaborative filtering ------------------------------------------------------------------------------------------

def _split(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return als.train_test_split(materialize(src.ratings(spark, d), "als-ratings"), ALS_CONFIG)


def _trained(spark: SparkSession, d: str):
    train, test = _split(spark, d)
    return als.als_train(train, ALS_CONFIG), test


@query
def train_test_split(spark, d):
    """Both parts together, and whether the training part has about its share of rows."""
    train, test = _split(spark, d)
    both = train.withColumn("inTrain", F.lit(1)).unionByName(test.withColumn("inTrain", F.lit(0)))
    off = F.abs(F.avg("inTrain") - ALS_CONFIG.train_share)
    return both.agg(
        F.count("*").alias("rows"),
        F.sum("ratingActual").alias("ratingSum"),
        F.count_distinct("userId", "movieId", "timestampEpochSeconds").alias("distinctRows"),
        (off < 0.05).alias("shareIsClose"),
    )


@query
def als_train(spark, d):
    """Trained on all ratings: who and what the model knows, and how long its vectors are."""
    model = als.als_train(materialize(src.ratings(spark, d), "als-ratings"), ALS_CONFIG)
    users_of = als.user_factors_of(model).select(F.lit("user").alias("side"), "features")
    items_of = als.item_factors_of(model).select(F.lit("item").alias("side"), "features")
    usable = F.count_if(vector_problem("features").isNull())
    return users_of.unionByName(items_of).groupBy("side").agg(
        F.count("*").alias("entities"), usable.alias("usable"), F.min(F.size("features")).alias("rank")
    )


def _all_trained(spark: SparkSession, d: str):
    """The stored ratings and a model of all of them."""
    rated = materialize(src.ratings(spark, d), "als-ratings")
    return rated, als.als_train(rated, ALS_CONFIG)


def _with_products(pairs: DataFrame, model) -> DataFrame:
    """(userId, movieId) pairs that the model knows, with the inner product of their factors."""
    users_of = als.user_factors_of(model).select("userId", F.col("features").alias("u"))
    items_of = als.item_factors_of(model).select(F.col("itemId").alias("movieId"), F.col("features").alias("v"))
    product = sum_of(F.col("u")[i].cast("double") * F.col("v")[i].cast("double") for i in range(model.rank))
    # Users come last, so that whatever follows per user finds the rows dealt by user already.
    return pairs.join(items_of, "movieId").join(users_of, "userId").withColumn("product", product).drop("u", "v")


@query
def als_rmse(spark, d):
    """Whether the error of a split model is that of the factors themselves, over all test rows it knows."""
    train, test = _split(spark, d)
    model = als.als_train(train, ALS_CONFIG)
    rmse = als.als_rmse(model, test)
    miss = F.col("ratingActual") - F.col("product")
    own = _with_products(test, model).agg(F.sqrt(F.sum(miss * miss) / F.count("*")).alias("own"))
    both = train.select(F.lit(1).alias("n")).unionAll(test.select(F.lit(1).alias("n"))).agg(F.count("*").alias("ratings"))
    return both.select(
        "ratings",
        (F.abs(own.scalar() - F.lit(rmse)) < 1e-4).alias("errorOfFactors"),
        F.lit(rmse).between(0.0, 4.5).alias("errorOnScale"),
    )


@query
def als_predict(spark, d):
    """Every pair of an event whose user and movie have ratings, and whether its prediction is their factors' product."""
    _, model = _all_trained(spark, d)
    pairs = src.interactions(spark, d).filter(F.col("movieId").isNotNull()).select("userId", "movieId").distinct()
    found = _with_products(als.als_predict(model, pairs), model)
    return found.select("userId", "movieId", (F.abs(F.col("prediction") - F.col("product")) < 1e-3).alias("productOfFactors"))


def _list_facts(lists: DataFrame) -> DataFrame:
    ratings_of = F.col("recommendations.rating")
    return lists.select(
        "userId",
        F.size("recommendations").cast("bigint").alias("movies"),
        F.size(F.array_distinct("recommendations.movieId")).cast("bigint").alias("distinctMovies"),
        (F.reverse(F.sort_array(ratings_of)) == ratings_of).alias("bestFirst"),
        F.array_min(ratings_of).alias("last"),
        F.col("recommendations.movieId").alias("listed"),
    )


@query
def als_recommend_all(spark, d):
    """Per user the length of the list, and whether it is in order and no rated movie that it leaves out is predicted higher."""
    rated, model = _all_trained(spark, d)
    lists = materialize(_list_facts(als.als_recommend_all(model)), "als-lists")
    pairs = rated.select("userId", "movieId").repartition("movieId").distinct()
    missed = _with_products(pairs, model).join(lists.select("userId", "listed", "last"), "userId")
    missed = missed.filter(~F.array_contains("listed", F.col("movieId"))).groupBy("userId").agg(F.max(F.col("product") - F.col("last")).alias("over"))
    return lists.join(missed, "userId", "left").select(
        "userId", "movies", "distinctMovies", "bestFirst", (F.coalesce("over", F.lit(0.0)) < 1e-4).alias("noneBetterLeftOut")
    )


@query
def als_recommend_subset(spark, d):
    """Per user with an event and ratings the length of the list, and whether it is the one among all users' lists."""
    _, model = _all_trained(spark, d)
    blocks = als.item_blocks_of(model)
    some = als.als_recommend_subset(model, src.interactions(spark, d), blocks=blocks)
    every = als.als_recommend_all(model, blocks=blocks).withColumnRenamed("recommendations", "among")
    return some.join(every, "userId").select(
        "userId", F.size("recommendations").cast("bigint").alias("movies"), (F.col("recommendations") == F.col("among")).alias("sameAsAmongAll")
    )


# --- recommendation documents --------------------------------------------------------------------------------------------

def _rec_docs(spark: SparkSession, d: str, rated: DataFrame | None = None, at: int = GENERATED_AT, version: str = "v1"):
    grouped = serving.group_recommendations(src.recs(spark, d, rated))
    return serving.recs_enriched(grouped, src.movies(spark, d), at, version)


def _flat(docs: DataFrame) -> DataFrame:
    """Documents as one row per recommendation, with its position."""
    keep = [c for c in docs.columns if c != "recommendations"]
    return docs.select(*keep, F.posexplode("recommendations").alias("pos", "rec")).select(
        *keep,
        (F.col("pos") + 1).alias("position"),
        F.col("rec.movieId").alias("movieId"),
        F.col("rec.rating").alias("rating"),
        F.col("rec.title").alias("title"),
        F.array_join("rec.genres", ";").alias("genreNames"),
    )


@query
def recs_enriched(spark, d):
    return _flat(_rec_docs(spark, d))


def _rec_versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rated, at = src.ratings(spark, d), F.col("timestampEpochSeconds")
    earlier = _rec_docs(spark, d, rated.filter(at < RATINGS_CUT), GENERATED_AT - 1, "v1")
    later = _rec_docs(spark, d, rated.filter(at >= RATINGS_CUT), GENERATED_AT, "v2")
    return earlier, later


@query
def recs_upsert(spark, d):
    return _flat(_stored("userId", serving.recs_upsert, *_rec_versions(spark, d)))


@query
def recs_by_user(spark, d):
    """For every user with an interaction event."""
    return _flat(serving.recs_by_user(_rec_docs(spark, d), src.interactions(spark, d)))


@query
def recs_by_user_topn(spark, d):
    return _flat(serving.recs_by_user_topn(_rec_docs(spark, d), src.interactions(spark, d), 3))


@query
def recs_batch(spark, d):
    return _flat(serving.recs_batch(_rec_docs(spark, d), serving.parse_user_ids("1, 2,3, 77 ,999999"), 4))


@query
def recs_exists(spark, d):
    return serving.recs_exists(_rec_docs(spark, d), src.interactions(spark, d))


# --- vectors ---------------------------------------------------------------------------------------------------------------

@query
def factor_table(spark, d):
    """Stored factors, decoded again so that the bytes are part of the result."""
    stored = vectors.factor_table(src.user_factors(spark, d), src.item_factors(spark, d), GENERATED_AT, "v1")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return vectors.decode_factors(stored.withColumn("byteLength", F.length("vector"))).select(
        "key", "entity_id", "entity_type", "dimension", "byteLength",
        F.round(total, 4).alias("featureSum"), "timestamp", "model_version",
    )


@query
def vector_validation(spark, d):
    return vectors.vector_validation(src.damaged_factors(spark, d))


def _cosine4(df: DataFrame) -> DataFrame:
    return df.withColumn("cosine", F.round("cosine", 4))


@query
def item_similar_items(spark, d):
    return _cosine4(vectors.item_similar_items(src.item_factors(spark, d), TOP_K))


@query
def user_similar_items(spark, d):
    found = vectors.user_similar_items(src.user_factors(spark, d), src.item_factors(spark, d), TOP_K, USER_SCORE_WEIGHT)
    return _cosine4(found).withColumn("score", F.round("score", 4))


@query
def item_similar_items_ann(spark, d):
    """Per item whether the approximate list is whole, in order and of true cosines; and, over all items, whether at least nine
    tenths of the exact neighbours are found in fewer comparisons than the exact search makes."""
    items = materialize(src.item_factors(spark, d), "ann-items")
    index = vector_index.build_index(items)
    near = materialize(vector_index.similar_items(index, items, TOP_K), "ann-found")
    exact = vectors.item_similar_items(items, TOP_K)
    same = exact.join(near.select("itemId", "neighborId", F.lit(1).alias("found")), ["itemId", "neighborId"], "left")
    recall = same.agg((F.count("found") >= 0.9 * F.count("*")).alias("mostNeighborsFound"))
    compared = vector_index.candidates(index, items.withColumnRenamed("itemId", "queryId"))
    pruned = compared.agg((F.sum("n") < F.count("*") * F.count("*")).alias("comparesLess"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    squares = items.select("itemId", "features", dot("features", "features").alias("square"))
    a, b = (squares.toDF(name, f"{name}Vector", f"{name}Square") for name in ("itemId", "neighborId"))
    length = F.sqrt(F.col("itemIdSquare") * F.col("neighborIdSquare"))
    true = near.join(a, "itemId").join(b, "neighborId").withColumn("true", dot("itemIdVector", "neighborIdVector") / length)
    rows = true.groupBy("itemId").agg(
        F.count("*").alias("neighbors"),
        (F.count_distinct("neighborId") == F.count("*")).alias("different"),
        (F.max(F.abs(F.col("true") - F.col("cosine"))) < 1e-6).alias("cosinesAreTrue"),
        F.array_sort(F.collect_list(F.struct("rank", "cosine"))).alias("listed"),
    )
    falling = F.reverse(F.sort_array(F.col("listed.cosine"))) == F.col("listed.cosine")
    return rows.select(
        "itemId", "neighbors", "different", "cosinesAreTrue", falling.alias("nearestFirst"),
        recall.scalar().alias("mostNeighborsFound"), pruned.scalar().alias("comparesLess"),
    )


# --- real time ------------------------------------------------------------------------------------------------------------

@query
def event_normalize(spark, d):
    return realtime.event_normalize(src.interactions(spark, d)).select("eventId", "eventType", "weight")


@query
def event_validate(spark, d):
    missing = src.interactions(spark, d).withColumn(
        "tsMicros", F.when(F.col("movieId").isNotNull(), F.col("tsMicros"))
    )
    return realtime.event_validate(missing, GENERATED_AT).select(
        "eventId", "userId", F.coalesce("movieId", F.lit(0)).alias("movieId"),
        "eventType", "rating", "tsMicros", "accepted", "reason",
    )


@query
def event_rec_budget(spark, d):
    return realtime.event_rec_budget(src.interactions(spark, d)).select(
        "eventId", "eventType", "weight", "k", "multiplier"
    )


def _recommended(spark: SparkSession, d: str, user_id: int | None = None) -> DataFrame:
    """For all events or, of one user, with lists of only those movies that the user's events are about."""
    events, seeds = src.interactions(spark, d), None
    if user_id is not None:
        events = events.filter(F.col("userId") == user_id)
        seeds = events.select("movieId")
    lists = vectors.neighbor_lists(src.item_factors(spark, d), TOP_K, seeds=seeds)
    return realtime.rt_recommendations(events, src.user_factors(spark, d), lists)


@query
def rt_recommendations(spark, d):
    return realtime.recommendation_rows(_recommended(spark, d)).withColumn("score", F.round("score", 4))


@query
def rt_processed_events(spark, d):
    return realtime.rt_processed_events(src.interactions(spark, d), src.user_factors(spark, d)).select(
        "eventId", "userId", "movieId", "eventType", "processed"
    )


@query
def rt_output_messages(spark, d):
    return realtime.rt_output_messages(_recommended(spark, d))


@query
def rt_recs_for_user(spark, d):
    return realtime.rt_recs_for_user(realtime.rt_output_messages(_recommended(spark, d, 42)), 42)
