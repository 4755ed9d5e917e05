import pytest
from pyspark.sql import functions as F

from rateframe.operators import als, serving
from rateframe.plans.prediction_job import run_predictions
from rateframe.plans.training_job import recommendation_store, run_training
from rateframe.sources import files

CONFIG = als.AlsConfig(rank=4, max_iter=3, reg_param=0.1, seed=7, blocks=2)
RATINGS = "userId int, movieId int, ratingActual double, timestampEpochSeconds bigint"


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(u, m, 4.5 if (u + m) % 2 else 1.0, u) for u in range(1, 31) for m in range(1, 21) if (u + 2 * m) % 3]
    return spark.createDataFrame(rows, RATINGS).persist()


@pytest.fixture(scope="module")
def model(rated):
    return als.als_train(rated, CONFIG)


def test_split_parts_make_up_the_whole(rated):
    train, test = als.train_test_split(rated, CONFIG)
    assert train.union(test).exceptAll(rated).isEmpty() and rated.exceptAll(train.union(test)).isEmpty()
    again, _ = als.train_test_split(rated, CONFIG)
    assert sorted(train.collect()) == sorted(again.collect())


def test_an_empty_training_part_is_an_error(rated):
    with pytest.raises(ValueError):
        als.train_test_split(rated.filter("false"), CONFIG)


def test_rmse(spark, model, rated):
    assert 0 <= als.als_rmse(model, rated) < 1.5
    assert als.als_rmse(model, rated.filter("false")) is None
    assert als.als_rmse(model, rated.drop("ratingActual")) is None


def test_predictions_leave_out_unknown_ids(spark, model, tmp_path):
    pairs = spark.createDataFrame([(1, 1), (999, 1), (1, 999), (999, 999)], "userId int, movieId int")
    predicted = als.als_predict(model, pairs)
    assert [(r.userId, r.movieId) for r in predicted.collect()] == [(1, 1)]
    files.write_csv(predicted, str(tmp_path / "predictions"))
    assert spark.read.option("header", True).csv(str(tmp_path / "predictions")).columns == ["userId", "movieId", "prediction"]


def test_recommendations_for_all_and_some(spark, model):
    every = als.als_recommend_all(model, 5)
    assert every.count() == 30
    assert all(len(r.recommendations) == 5 for r in every.collect())
    some = als.als_recommend_subset(model, spark.createDataFrame([(1,), (1,), (999,)], "userId int"), 5)
    assert [r.userId for r in some.collect()] == [1]


def test_a_saved_model_predicts_the_same(spark, model, tmp_path):
    als.save_model(model, str(tmp_path / "model"))
    loaded = als.load_model(str(tmp_path / "model"))
    pairs = spark.createDataFrame([(1, 1), (2, 5)], "userId int, movieId int")
    assert sorted(als.als_predict(loaded, pairs).collect()) == sorted(als.als_predict(model, pairs).collect())


def test_implicit_training_with_the_small_profile(rated):
    small = als.AlsConfig(rank=3, max_iter=2, reg_param=0.2, seed=42, implicit=True, alpha=0.5, train_share=0.7, blocks=2)
    assert als.item_factors_of(als.als_train(rated, small)).count() == 20


def test_training_job_end_to_end(spark, rated, tmp_path):
    movies = spark.createDataFrame([(m, f"title {m}", "A|B") for m in range(1, 16)], "movieId int, title string, genres string")
    result = run_training(rated, movies, CONFIG, 1000, "v1", str(tmp_path / "run"))
    assert result["rmse"] is not None
    docs = recommendation_store(spark, str(tmp_path / "run")).read()
    assert docs.count() == 30 and spark.read.parquet(str(tmp_path / "run" / "factors")).count() == 50
    for doc in docs.collect():
        ratings = [x.rating for x in doc.recommendations]
        assert len(ratings) == 10 and ratings == sorted(ratings, reverse=True)
        assert all((x.title is None) == (x.movieId > 15) for x in doc.recommendations)


LIST = "userId int, recommendations array<struct<movieId:int,rating:double>>"


@pytest.fixture(scope="module")
def docs(spark):
    lists = spark.createDataFrame([(1, [(5, 1.0), (6, 3.0), (4, 3.0)]), (2, [(5, 2.0)])], LIST)
    movies = spark.createDataFrame([(5, "five", "X|Y"), (6, "six", None)], "movieId int, title string, genres string")
    return serving.recs_enriched(lists, movies, 100, "v1").persist()


def test_documents_are_sorted_and_titled(docs):
    first = docs.filter("userId = 1").first()
    assert [(x.movieId, x.title, x.genres) for x in first.recommendations] == [
        (4, None, None), (6, "six", []), (5, "five", ["X", "Y"])
    ]
    assert (first.generatedAt, first.modelVersion) == (100, "v1")


def test_documents_without_metadata(spark):
    lists = spark.createDataFrame([(1, [(5, 1.0), (6, 3.0)])], LIST)
    row = serving.recs_enriched(lists, None, 1, "v").first()
    assert [(x.movieId, x.title) for x in row.recommendations] == [(6, None), (5, None)]


def test_upsert_by_user(spark, docs):
    newer = serving.recs_enriched(spark.createDataFrame([(2, [(9, 5.0)]), (3, [(9, 5.0)])], LIST), None, 200, "v2")
    merged = {r.userId: r.modelVersion for r in serving.recs_upsert(docs, newer).collect()}
    assert merged == {1: "v1", 2: "v2", 3: "v2"}
    assert tuple(serving.recs_upsert_counts(docs, newer).first()) == (1, 1)


def test_lookups(spark, docs):
    assert serving.recs_by_user(docs, 1).first().totalRecommendations == 3
    assert serving.recs_by_user(docs, 9).isEmpty()
    assert [x.movieId for x in serving.recs_by_user_topn(docs, 1, 2).first().recommendations] == [4, 6]
    wanted = spark.createDataFrame([(2,), (2,), (9,)], "userId int")
    assert {r.userId: r.exists for r in serving.recs_exists(docs, wanted).collect()} == {2: True, 9: False}
    assert [r.userId for r in serving.recs_by_user(docs, wanted).collect()] == [2]


@pytest.mark.parametrize("n", [0, 11])
def test_top_n_bounds(docs, n):
    with pytest.raises(ValueError):
        serving.recs_by_user_topn(docs, 1, n)


def test_batch_lookup_bounds(docs):
    assert {r.userId for r in serving.recs_batch(docs, list(range(1, 101))).collect()} == {1, 2}
    assert serving.recs_batch(docs, [1], 2).first().totalRecommendations == 2
    for ids, limit in (([], None), (list(range(101)), None), ([1], 0)):
        with pytest.raises(ValueError):
            serving.recs_batch(docs, ids, limit)


def test_id_lists():
    assert serving.parse_user_ids("1, 2,3 ") == [1, 2, 3]
    with pytest.raises(ValueError):
        serving.parse_user_ids("1,x")


def test_prediction_job_from_file_to_file(spark, model, tmp_path):
    als.save_model(model, str(tmp_path / "model"))
    pairs = [(1, 1), (1, 2), (2, 1), (2, 1), (999, 999), (1, 999), (999, 1)]
    (tmp_path / "pairs.csv").write_text("userId,movieId\n" + "".join(f"{u},{m}\n" for u, m in pairs) + "no,pair\n")
    counts = run_predictions(spark, str(tmp_path / "model"), str(tmp_path / "pairs.csv"), str(tmp_path / "out"))
    assert counts == {"predictions": 4, "unknown": 3}
    predicted = spark.read.option("header", True).option("inferSchema", True).csv(str(tmp_path / "out" / "predictions"))
    expected = als.als_predict(model, spark.createDataFrame(pairs[:3], "userId int, movieId int"))
    assert {(r.userId, r.movieId, round(r.prediction, 4)) for r in predicted.collect()} == {
        (r.userId, r.movieId, round(r.prediction, 4)) for r in expected.collect()
    }
    unknown = spark.read.option("header", True).csv(str(tmp_path / "out" / "unknown")).collect()
    assert {(r.userId, r.movieId, r.reason) for r in unknown} == {
        ("999", "999", "UNKNOWN_USER_AND_MOVIE"), ("1", "999", "UNKNOWN_MOVIE"), ("999", "1", "UNKNOWN_USER")
    }
