import json

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from rateframe.operators import vectors
from rateframe.sources import derived_inputs as src
from rateframe.streaming import realtime

EVENTS = realtime.EVENT_SCHEMA


def events(spark, rows):
    return spark.createDataFrame(rows, EVENTS)


@pytest.fixture(scope="module")
def lists(spark):
    near = [(1, 1.0), (2, 0.9), (3, 0.5), (4, -0.2), (5, -0.9)]
    entry = [(rank, movie, cosine) for rank, (movie, cosine) in enumerate(near, 1)]
    return spark.createDataFrame(
        [(1, entry)], "seedId int, neighbors array<struct<rank:int,movieId:int,cosine:double>>"
    )


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame([(7,), (7,)], "userId int")


def test_names_weights_and_budgets(spark):
    kinds = ["rating-given", "Movie_Viewed", "ADDED-TO-watchlist", "movie_clicked", "searched-for-movie", "other", None]
    df = realtime.event_rec_budget(events(spark, [(i, 1, 1, k, None, 0) for i, k in enumerate(kinds)]))
    got = [(r.eventType, r.weight, r.k, r.multiplier) for r in df.orderBy("eventId").collect()]
    assert got == [
        ("RATING_GIVEN", 5.0, 5, 2.0), ("MOVIE_VIEWED", 3.0, 3, 1.2), ("ADDED_TO_WATCHLIST", 2.0, 2, 0.8),
        ("MOVIE_CLICKED", 1.0, 1, 0.5), ("SEARCHED_FOR_MOVIE", 0.5, 1, 0.5), ("UNKNOWN", 0.0, 1, 0.5),
        ("UNKNOWN", 0.0, 1, 0.5),
    ]


@pytest.mark.parametrize("user, movie, kind, rating, reason", [
    (0, 1, "MOVIE_VIEWED", None, "USER_NOT_POSITIVE"),
    (1, 1, "nothing", None, "UNKNOWN_EVENT_TYPE"),
    (1, 0, "MOVIE_VIEWED", None, "MOVIE_NOT_POSITIVE"),
    (1, None, "MOVIE_VIEWED", None, None),
    (1, 1, "RATING_GIVEN", None, "RATING_MISSING"),
    (1, 1, "rating-given", 5.5, "RATING_OUT_OF_RANGE"),
    (1, 1, "RATING_GIVEN", 0.5, None),
    (1, 1, "MOVIE_VIEWED", 9.0, None),
])
def test_validation(spark, user, movie, kind, rating, reason):
    row = realtime.event_validate(events(spark, [(1, user, movie, kind, rating, None)]), 99).first()
    assert (row.reason, row.accepted, row.tsMicros) == (reason, reason is None, 99)


def recommended(spark, rows, known, lists, **options):
    df = realtime.rt_recommendations(events(spark, rows), known, lists, **options)
    return {r.eventId: [(x.movieId, round(x.predictedRating, 6)) for x in r.recommendations] for r in df.collect()}


@pytest.mark.parametrize("salts", [1, 4])
def test_neighbours_include_the_seed_before_it_is_dropped(spark, known, lists, salts):
    rows = [
        (1, 7, 1, "RATING_GIVEN", 4.0, 0), (2, 7, 1, "MOVIE_VIEWED", None, 0), (3, 7, 1, "MOVIE_CLICKED", None, 0),
        (4, 8, 1, "RATING_GIVEN", 4.0, 0), (5, 7, None, "MOVIE_VIEWED", None, 0), (6, 7, 99, "MOVIE_VIEWED", None, 0),
        (7, 7, 1, "what", None, 0),
    ]
    assert recommended(spark, rows, known, lists, salts=salts) == {
        1: [(2, 5.0), (3, 5.0), (4, -2.0), (5, -9.0)], 2: [(2, 5.0), (3, 3.0)], 3: [],
    }
    processed = realtime.rt_processed_events(events(spark, rows), known, salts).collect()
    assert sorted(r.eventId for r in processed) == [1, 2, 3, 6]


def test_dropping_the_seed_first_gives_k(spark, known, lists):
    got = recommended(spark, [(3, 7, 1, "MOVIE_CLICKED", None, 0)], known, lists, exclude_seed_first=True)
    assert got == {3: [(2, 2.25)]}


def test_messages(spark, known, lists):
    rows = [(1, 7, 1, "ADDED_TO_WATCHLIST", None, 5), (2, 7, 1, "MOVIE_CLICKED", None, 5)]
    found = realtime.rt_output_messages(realtime.rt_recommendations(events(spark, rows), known, lists)).collect()
    assert [(r.eventId, r.key) for r in found] == [(1, "7")]
    assert json.loads(found[0].value) == [{"userId": 7, "movieId": 2, "predictedRating": 3.6, "generatedAt": 5}]
    assert realtime.rt_recs_for_user(spark.createDataFrame(found), 7).count() == 1


def test_event_messages_parse_and_bad_ones_drop(spark):
    values = ['{"eventId": 1, "userId": 2, "movieId": 3, "eventType": "MOVIE_VIEWED"}', "not json", '{"eventId": 4}']
    got = realtime.parse_event_messages(spark.createDataFrame([(v,) for v in values], "value string")).collect()
    assert [(r.eventId, r.userId, r.movieId, r.rating) for r in got] == [(1, 2, 3, None)]


@pytest.fixture
def models(spark, known, lists, tmp_path):
    store = realtime.ModelStore(spark, str(tmp_path / "models"))
    store.publish(known, lists)
    return store


def run(source, models, tmp_path, **options):
    query = realtime.start_recommendation_stream(
        source, models, str(tmp_path / "out"), str(tmp_path / "checkpoint"), trigger={"availableNow": True}, **options
    )
    try:
        assert query.awaitTermination(120)
    except StreamingQueryException as error:
        return error


def output(spark, tmp_path, name):
    return realtime.read_outputs(spark, str(tmp_path / "out"), name)


def test_stream_keeps_messages_that_are_no_event(spark, models, tmp_path):
    values = ['{"eventId": 1, "userId": 7, "movieId": 1, "eventType": "MOVIE_VIEWED"}', "not json", '{"eventId": 4}', None,
              '{"eventId": 5, "userId": -1, "movieId": 1, "eventType": "MOVIE_VIEWED"}']
    spark.createDataFrame([(v,) for v in values], "value string").write.parquet(str(tmp_path / "in"))
    messages = spark.readStream.schema("value string").parquet(str(tmp_path / "in"))
    assert run(messages, models, tmp_path, validate=True) is None
    rejected = output(spark, tmp_path, "rejected").collect()
    assert sorted((r.reason, str(r.message)) for r in rejected) == sorted(
        [("NO_EVENT", "not json"), ("NO_EVENT", '{"eventId": 4}'), ("NO_EVENT", "None"), ("USER_NOT_POSITIVE", "None")]
    )
    assert [r.eventId for r in output(spark, tmp_path, "messages").collect()] == [1]


def test_stream_equals_batch(spark, data, tmp_path):
    source = src.interactions(spark, data)
    source.repartition(5).write.parquet(str(tmp_path / "events"))
    users = src.user_factors(spark, data)
    neighbours = vectors.neighbor_lists(src.item_factors(spark, data), 5).persist()
    models = realtime.ModelStore(spark, str(tmp_path / "models"))
    models.publish(users, neighbours)
    assert run(realtime.read_event_files(spark, str(tmp_path / "events"), files_per_trigger=2), models, tmp_path) is None
    assert realtime.committed_batches(spark, str(tmp_path / "out")).count() == 3
    batch = realtime.rt_output_messages(realtime.rt_recommendations(source, users, neighbours))
    got = output(spark, tmp_path, "messages")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    expected = realtime.rt_processed_events(source, users)
    assert sorted(r.eventId for r in output(spark, tmp_path, "processed").collect()) == sorted(r.eventId for r in expected.collect())
    neighbours.unpersist()


def test_validated_stream_keeps_rejected_events(spark, models, tmp_path):
    rows = [(1, 7, 1, "MOVIE_VIEWED", None, 5), (2, -1, 1, "MOVIE_VIEWED", None, 5), (3, 7, 1, "RATING_GIVEN", 9.0, 5)]
    events(spark, rows).write.parquet(str(tmp_path / "events"))
    assert run(realtime.read_event_files(spark, str(tmp_path / "events")), models, tmp_path, validate=True) is None
    kept = {n: sorted(r.eventId for r in output(spark, tmp_path, n).collect()) for n in ("messages", "rejected")}
    assert kept == {"messages": [1], "rejected": [2, 3]}


def test_a_new_model_counts_from_the_next_batch_on(spark, known, lists, models, tmp_path):
    arrive = lambda i: events(spark, [(i, 7, 1, "MOVIE_CLICKED", None, 5), (10 + i, 9, 1, "MOVIE_VIEWED", None, 5)]).write.mode("append").parquet(str(tmp_path / "events"))
    arrive(1)
    query = realtime.start_recommendation_stream(
        realtime.read_event_files(spark, str(tmp_path / "events")), models, str(tmp_path / "out"), str(tmp_path / "checkpoint"),
        trigger={"processingTime": "0 seconds"},
    )
    query.processAllAvailable()
    other = spark.createDataFrame([(1, [(1, 8, 0.5)])], "seedId int, neighbors array<struct<rank:int,movieId:int,cosine:double>>")
    assert models.publish(spark.createDataFrame([(9,)], "userId int"), other) == 2
    arrive(2)
    query.processAllAvailable()
    query.stop()
    done = {r.eventId: r.userId for r in output(spark, tmp_path, "processed").collect()}
    assert done == {1: 7, 12: 9}
    said = {r.eventId: [x["movieId"] for x in json.loads(r.value)] for r in output(spark, tmp_path, "messages").collect()}
    assert said[12] == [8] and 2 not in said
    assert [(r.batch, r.model) for r in realtime.committed_batches(spark, str(tmp_path / "out")).orderBy("batch").collect()] == [(0, 1), (1, 2)]


@pytest.mark.parametrize("when", ["while writing", "before the commit", "after the commit"])
def test_a_restarted_stream_has_each_event_once_in_each_output(spark, models, tmp_path, monkeypatch, when):
    rows = [(i, 7, 1, "MOVIE_VIEWED", None, 5) for i in range(20)]
    events(spark, rows).repartition(4).write.parquet(str(tmp_path / "events"))
    source = lambda: realtime.read_event_files(spark, str(tmp_path / "events"), files_per_trigger=2)
    commit, outputs_of = realtime.VersionedFolder.commit, realtime.outputs_of

    def killed(log, number, content):
        if number == 1:
            if when == "after the commit":
                commit(log, number, content)
            raise RuntimeError("killed")
        return commit(log, number, content)

    def halfway(batch, *rest):
        found = outputs_of(batch, *rest)
        found["processed"] = found["processed"].withColumn("lost", realtime.F.raise_error(realtime.F.lit("killed")).cast("string"))
        return found

    with monkeypatch.context() as m:
        if when == "while writing":
            m.setattr(realtime, "outputs_of", halfway)
        else:
            m.setattr(realtime.VersionedFolder, "commit", killed)
        assert "killed" in str(run(source(), models, tmp_path))
    assert run(source(), models, tmp_path) is None
    for name in ("messages", "processed"):
        assert sorted(r.eventId for r in output(spark, tmp_path, name).collect()) == list(range(20))


def test_topic_rows(spark, known, lists):
    rows = events(spark, [(1, 7, 1, "MOVIE_VIEWED", None, 5), (2, -1, 1, "MOVIE_VIEWED", None, 5)])
    sent = realtime.topic_rows(realtime.outputs_of(rows, known, lists, validate=True))
    assert {n: [r.key for r in df.collect()] for n, df in sent.items()} == {"messages": ["7"], "processed": ["7"], "rejected": ["-1"]}
    assert json.loads(sent["rejected"].first().value)["reason"] == "USER_NOT_POSITIVE"


def test_no_model_and_no_output(spark, tmp_path):
    with pytest.raises(ValueError, match="no model"):
        realtime.ModelStore(spark, str(tmp_path)).newest()


def test_only_rating_events_keep_a_rating(spark):
    found = realtime.event_normalize(events(spark, [(1, 7, 1, "rating-given", 4.0, 5), (2, 7, 1, "MOVIE_VIEWED", 4.0, 5), (3, 7, 1, "x", 1.0, 5)]))
    assert {r.eventId: r.rating for r in found.collect()} == {1: 4.0, 2: None, 3: None}
