"""What the plans must look like to hold on large tables, and what skewed data must not change."""

import re

import pytest
from pyspark.sql import functions as F

from rateframe.operators import content, documents, quality, serving, tags as tag_ops, users
from rateframe.operators.facts import pair_facts
from rateframe.plans.catalog import QUERIES
from rateframe.session import hold, shared_dir
from rateframe.sources import derived_inputs as src
from rateframe.sources.keyed_store import KeyedStore

# These run jobs while the plan is built, or end in a model.
RUN_EAGERLY = {
    "ingest_ratings", "ingest_movies", "ingest_tags", "prediction_pairs", "run_timing",
    "analytics_metrics_long", "analytics_documents", "analytics_run_status",
}
PLANNED = sorted(n for n in QUERIES if n not in RUN_EAGERLY and not n.startswith(("chart_", "als_", "train_")))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_small_tables(spark):
    """Plan as if no table were small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", PLANNED)
def test_no_query_pairs_all_rows_with_all_rows(spark, data, no_small_tables, name):
    shown = plan(QUERIES[name](spark, data))
    assert "CartesianProduct" not in shown
    assert "BroadcastNestedLoopJoin" not in shown
    assert "BatchEvalPython" not in shown


@pytest.mark.parametrize("name, unused", [
    ("rating_histogram", ("l_quantity", "l_suppkey")),
    ("user_profile", ("l_quantity", "l_suppkey")),
    ("tag_totals", ("l_shipdate", "l_discount")),
    ("event_normalize", ("props", "user_id", "ts")),
    ("analytics_counts_by_type", ("props", "ts", "value", "user_id")),
])
def test_unused_columns_are_not_read(spark, data, name, unused):
    read = [line for line in plan(QUERIES[name](spark, data)).splitlines() if "ReadSchema" in line]
    schema = " ".join(line.split("ReadSchema", 1)[1] for line in read)
    assert schema
    for column in unused:
        assert not re.search(rf"\b{column}:", schema)


def test_filters_reach_the_scan(spark, data, tmp_path):
    store = KeyedStore(spark, str(tmp_path), "userId")
    store.upsert(src.recs(spark, data).groupBy("userId").agg(F.collect_list("movieId").alias("recommendations")), lambda old, new: new)
    assert "PushedFilters: [IsNotNull(userId), EqualTo(userId,42)" in plan(serving.recs_by_user(store.read(), 42))


@pytest.mark.parametrize("name", ["analytics_latest_by_type", "genre_top_tags", "recs_enriched"])
def test_groups_are_cut_to_their_best_rows_before_the_shuffle(spark, data, name):
    shown = plan(QUERIES[name](spark, data))
    assert "WindowGroupLimit" in shown and "Partial" in shown


def test_upserts_keep_the_newest_rows_before_the_shuffle(spark, data):
    docs = src.analytics_docs(spark, data)
    assert "WindowGroupLimit" in plan(documents.analytics_upsert(docs, docs))


def test_whole_sorts_are_not_needed_for_top_lists(spark, data):
    for name in ("top_users", "top_movies", "tag_rating_affinity", "analytics_query"):
        assert "TakeOrderedAndProject" in plan(QUERIES[name](spark, data))


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all ratings by one user, a third on one movie, and many exact copies."""
    i = F.col("id").cast("int")
    return spark.range(60000).select(
        F.when(i % 3 == 0, 1).otherwise(i % 997 + 2).cast("int").alias("userId"),
        F.when(i % 3 == 1, 1).otherwise(i % 89 + 2).cast("int").alias("movieId"),
        ((i % 10 + 1) / 2).cast("double").alias("ratingActual"),
        (i % 5000).cast("bigint").alias("timestampEpochSeconds"),
    ).persist()


def test_hot_user_and_hot_movie_fold_before_they_meet(spark, skewed):
    pairs = pair_facts(skewed)
    largest = pairs.groupBy("userId").count().agg(F.max("count")).first()[0]
    assert largest <= 90
    hot = users.user_profile(pairs).filter("userId = 1").first()
    plain = skewed.filter("userId = 1").agg(
        F.count("*"), F.avg("ratingActual"), F.stddev_samp("ratingActual"), F.count_distinct("movieId")
    ).first()
    assert (hot.totalRatings, hot.uniqueMovies) == (plain[0], plain[3])
    assert (hot.avgRating, hot.ratingStdDev) == (pytest.approx(plain[1]), pytest.approx(plain[2]))
    movie = content.movie_performance(content.movie_facts(pairs)).filter("movieId = 1").first()
    assert movie.totalRatings == skewed.filter("movieId = 1").count()
    assert quality.dq_duplicates(skewed).first().uniqueRecords == skewed.distinct().count()


def test_affinity_on_a_hot_pair_counts_all_matches(spark):
    rated = spark.range(3000).select(
        F.lit(1).alias("userId"), F.lit(1).alias("movieId"), F.lit(4.0).alias("ratingActual"),
        F.col("id").alias("timestampEpochSeconds"),
    )
    tags = spark.range(2000).select(F.lit(1).alias("userId"), F.lit(1).alias("movieId"), F.lit("t").alias("tag"))
    assert tuple(tag_ops.tag_rating_affinity(tags, pair_facts(rated)).first()) == ("t", 4.0, 6_000_000)


def test_upsert_with_a_hot_id(spark):
    docs = spark.range(9000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("analyticsId"),
        F.col("id").alias("generatedAtMicros"), F.lit("T").alias("type"), F.lit("d").alias("description"),
    )
    merged = documents.analytics_upsert(docs.filter("id < 4500"), docs.filter("id >= 4500"))
    assert merged.count() == 6001
    assert merged.filter("analyticsId = 'hot'").first().generatedAtMicros == 8997


def test_held_rows_are_bounded(spark):
    assert hold(spark.range(3), 3).count() == 3
    with pytest.raises(ValueError):
        hold(spark.range(4), 3)


def test_intermediate_tables_go_where_the_session_says(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("name", [
    "top_users", "user_activity_summary", "activity_levels", "segmentation_score", "user_skew", "movie_popularity",
    "movie_popularity_summary", "top_movies", "top_movie_tags", "genre_fallback", "content_performance_flags", "dq_orphan_ratings",
])
def test_reports_without_distinct_counts_fold_ratings_once(spark, data, no_small_tables, name):
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(QUERIES[name](spark, data)))
    assert dealt and not any("userId" in d and "movieId" in d for d in dealt)


def test_genres_are_one_pass_with_few_shuffles(spark, data):
    shown = plan(QUERIES["genre_stats"](spark, data))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", shown)
    assert shown.count("FileScan") == 3  # lines, orders, parts
    assert len(dealt) <= 4 and not any("userId" in d for d in dealt)


@pytest.mark.parametrize("name", ["dq_freshness", "freshness_recent", "freshness_trend"])
def test_freshness_reads_ratings_once(spark, data, monkeypatch, name):
    plans = []
    keep = quality.materialize
    monkeypatch.setattr(quality, "materialize", lambda df, label: (plans.append(plan(df)), keep(df, label))[1])
    plans.append(plan(QUERIES[name](spark, data)))
    assert sum(p.count("lineitem.parquet") for p in plans) == 1 and sum(p.count("orders.parquet") for p in plans) == 1
