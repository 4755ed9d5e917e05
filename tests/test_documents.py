import pytest
from pyspark.sql import functions as F

from rateframe.operators import charts, documents
from rateframe.operators.metrics import METRIC_SCHEMA, metric_rows
from rateframe.plans import analytics_job, collectors
from rateframe.plans.collectors import Inputs

DOCS = "analyticsId string, generatedAtMicros bigint, type string, description string"
RATINGS = "userId int, movieId int, ratingActual double, timestampEpochSeconds bigint"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(f"d{i}", i * 10, "DATA_QUALITY" if i % 2 else "USER_ACTIVITY", f"Report {i}") for i in range(1, 26)]
    return spark.createDataFrame(rows, DOCS)


def ids(df):
    return [r.analyticsId for r in df.collect()]


def test_default_page_is_newest_first(docs):
    assert ids(documents.analytics_query(docs)) == [f"d{i}" for i in range(25, 5, -1)]
    assert ids(documents.analytics_query(docs, page=1)) == [f"d{i}" for i in range(5, 0, -1)]
    assert ids(documents.analytics_query(docs, page=2)) == []


def test_filters_apply_in_order_of_precedence(docs):
    assert ids(documents.analytics_query(docs, analytics_id="d3", types=["USER_ACTIVITY"], keyword="zzz")) == ["d3"]
    got = ids(documents.analytics_query(docs, types=["DATA_QUALITY"], from_micros=210, keyword="zzz"))
    assert got == ["d25", "d23"]
    assert ids(documents.analytics_query(docs, from_micros=230, keyword="zzz")) == ["d25", "d24"]
    assert ids(documents.analytics_query(docs, keyword="REPORT 2$")) == ["d2"]


def test_date_range_excludes_both_ends(docs):
    assert ids(documents.analytics_query(docs, from_micros=20, to_micros=50)) == ["d4", "d3"]


@pytest.mark.parametrize("page, size", [(0, 0), (0, 101), (-1, 20)])
def test_page_bounds(docs, page, size):
    with pytest.raises(ValueError):
        documents.analytics_query(docs, page=page, size=size)


@pytest.mark.parametrize("page, expected", [(0, (25, 3, True, False)), (2, (25, 3, False, True)), (9, (25, 3, False, True))])
def test_counts_and_page_flags(docs, page, expected):
    assert tuple(documents.analytics_count(docs, page=page, size=10).first()) == expected


def test_count_uses_the_same_filter_as_the_query(docs):
    assert documents.analytics_count(docs, keyword="report 2$").first().totalElements == 1


def test_upsert_replaces_and_adds(spark, docs):
    incoming = spark.createDataFrame(
        [("d1", 5, "DATA_QUALITY", "older time, later write"), ("new", 1, "X", "a"), ("new", 2, "X", "b")], DOCS
    )
    merged = {r.analyticsId: r for r in documents.analytics_upsert(docs, incoming).collect()}
    assert len(merged) == 26
    assert merged["d1"].description == "older time, later write" and merged["new"].description == "b"
    assert tuple(documents.upsert_counts(docs, incoming, "analyticsId").first()) == (1, 1)


def test_summary_shares(spark):
    rows = [(f"a{i}", i, "USER_ACTIVITY", "") for i in range(60)] + [(f"q{i}", i, "DATA_QUALITY", "") for i in range(40)]
    got = {r.category: (r.totalAnalytics, r.categoryCount, r.categoryPercentage)
           for r in documents.analytics_summary(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {"User Behavior": (100, 60, 60.0), "Data Quality": (100, 40, 40.0)}


def test_type_reports(spark, docs):
    odd = docs.union(spark.createDataFrame([("x", 1, "MYSTERY", "")], DOCS))
    assert {r.type: r.documents for r in documents.analytics_counts_by_type(odd).collect()} == {
        "DATA_QUALITY": 13, "USER_ACTIVITY": 12
    }
    exists = {r.type: r.exists for r in documents.analytics_exists_by_type(odd).collect()}
    assert len(exists) == 13 and sum(exists.values()) == 2
    assert sorted(ids(documents.analytics_latest_by_type(odd))) == ["d24", "d25", "x"]
    assert documents.analytics_type_catalog(spark).filter("isContentAnalytics").count() == 5


def metrics(spark, rows, collector="C", kind="DATA_QUALITY"):
    full = [(collector, kind, key, label, float(seq), value, None, None) for key, label, seq, value in rows]
    return spark.createDataFrame(full, METRIC_SCHEMA)


def test_document_keeps_the_metric_written_last(spark):
    rows = [("genre_scifi_count", "sci-fi", -5, 5.0), ("genre_scifi_count", "scifi", -2, 2.0), ("total", None, 0, 7.0)]
    long = metrics(spark, rows, "CONTENT_ANALYTICS", "GENRE_DISTRIBUTION")
    doc = documents.analytics_documents(long, "r1", 9).first()
    assert doc.analyticsId == "content_analytics_genre_r1"
    assert {k: v.value_double for k, v in doc.metrics.items()} == {"genre_scifi_count": 2.0, "total": 7.0}


def test_blank_keys_and_empty_values_are_no_metrics(spark):
    df = spark.createDataFrame([(" ", 1.0), ("k", None), ("ok", 2.0)], "name string, v double")
    got = metric_rows(df, "C", "T", [("name", "v")]).collect()
    assert [(r.metric_key, r.value_double) for r in got] == [("ok", 2.0)]


def test_chart_of_no_engaged_users_is_empty(spark):
    long = metrics(spark, [("totalEngagedUsers", None, 0, 0.0)], "USER_ENGAGEMENT", "USER_ENGAGEMENT")
    assert charts.chart_engagement(long).isEmpty()


def test_segmentation_chart_always_has_nine_cells(spark):
    long = metrics(spark, [("segment_High_Neutral", None, 0, 4.0)], "USER_SEGMENTATION", "USER_SEGMENTATION")
    assert [tuple(r) for r in charts.chart_segmentation(long).collect()] == [
        ("Low", 0, 0, 0), ("Medium", 0, 0, 0), ("High", 0, 4, 0)
    ]


def test_yearly_chart_of_other_years(spark):
    long = metrics(spark, [(f"year_{y}_count", None, 0, 1.0) for y in (1994, 1995, 2023, 2024)], "TEMPORAL_TRENDS", "TEMPORAL_TRENDS")
    years = lambda *a: [r.year for r in charts.chart_yearly(long, *a).collect()]
    assert (years(), years((2023, 2030)), years(None)) == ([1995, 2023], [2023, 2024], [1994, 1995, 2023, 2024])


def test_weekly_chart_starts_on_sunday(spark):
    long = metrics(spark, [(f"dayOfWeek_{d}_count", None, 0, float(d)) for d in (7, 1, 2)], "TEMPORAL_TRENDS", "TEMPORAL_TRENDS")
    assert [(r.day, r.ratingCount) for r in charts.chart_weekly(long).collect()] == [("Sun", 1), ("Mon", 2), ("Sat", 7)]


def test_numeric_values(spark):
    raw = ['{"$numberLong": "12"}', '{"$date": "1970-01-01T00:00:01Z"}', "3.5", '"text"', None, '{"other": 1}', "true"]
    got = charts.metric_numeric_value(spark.createDataFrame([(r,) for r in raw], "raw string")).collect()
    assert [r.value for r in got] == [12.0, 1000.0, 3.5, 0.0, 0.0, 0.0, 0.0]


@pytest.fixture(scope="module")
def small(spark):
    rated = spark.createDataFrame([(u, m, (u + m) % 10 / 2 + 0.5, u * 1000 + m) for u in range(1, 6) for m in range(1, 5)], RATINGS)
    return Inputs(rated, None, None, as_of=10_000)


def test_job_without_movies_and_tags(spark, small):
    statuses, docs = analytics_job.run_collectors(small, "r1", 1)
    by_name = {r.collector: r for r in statuses.collect()}
    assert by_name["TAG_ANALYTICS"].status == "SKIPPED"
    assert {r.status for n, r in by_name.items() if n != "TAG_ANALYTICS"} == {"SUCCESS"}
    genre = docs.filter("type = 'GENRE_DISTRIBUTION'").first()
    assert genre.analyticsId == "content_analytics_genre_fallback_r1"
    assert genre.metrics["genreDataAvailable"].value_bool is False
    assert genre.metrics["totalMovies"].value_double == 4.0
    assert not documents.metrics_of(docs).isEmpty()


def test_a_failing_collector_does_not_stop_the_others(spark, small):
    def broken(_):
        raise RuntimeError("no luck")

    chosen = (collectors.Collector("DATA_QUALITY", broken), *collectors.select_collectors("data_freshness", "unknown"))
    statuses, docs = analytics_job.run_collectors(small, "r1", 1, chosen)
    assert [(r.collector, r.status, r.message) for r in statuses.collect()] == [
        ("DATA_QUALITY", "FAILURE", "no luck"), ("DATA_FRESHNESS", "SUCCESS", None)
    ]
    assert docs.count() == 1


def test_missing_columns_and_empty_ratings_skip(spark, small):
    narrow = Inputs(small.ratings.drop("movieId"), None, None, as_of=0)
    assert not collectors.select_collectors("USER_ACTIVITY")[0].can_process(narrow)
    empty = Inputs(small.ratings.filter("false"), None, None, as_of=0)
    assert not any(c.can_process(empty) for c in collectors.COLLECTORS)
