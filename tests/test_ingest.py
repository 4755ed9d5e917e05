import pytest
from pyspark.sql import functions as F

from rateframe.operators import ingest
from rateframe.sources import files

RAW = "userId string, movieId string, rating string, timestamp string"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_clean_and_quarantine_split_every_row(spark):
    raw = spark.createDataFrame(
        [
            (" 1 ", "10", " 4.5", "100"),
            ("2", "10", "0.5", "100"),
            ("3", "10", "5.0", "100"),
            (None, "10", "4.0", "100"),
            ("x", "10", "4.0", "100"),
            ("1", "1.5", "4.0", "100"),
            ("1", "10", "good", "100"),
            ("1", "10", "4.0", "soon"),
            ("0", "10", "4.0", "100"),
            ("1", "-3", "4.0", "100"),
            ("1", "10", "5.5", "100"),
            ("1", "10", "0.4", "100"),
        ],
        RAW,
    )
    good = rows(ingest.clean_ratings(raw), "userId")
    assert good == [(1, 10, 4.5, 100), (2, 10, 0.5, 100), (3, 10, 5.0, 100)]
    reasons = sorted(r.reason for r in ingest.quarantine_ratings(raw).collect())
    assert reasons == sorted([
        "MISSING_VALUE", "UNREADABLE_USER", "UNREADABLE_MOVIE", "UNREADABLE_RATING", "UNREADABLE_TIMESTAMP",
        "USER_NOT_POSITIVE", "MOVIE_NOT_POSITIVE", "RATING_OUT_OF_RANGE", "RATING_OUT_OF_RANGE",
    ])
    assert len(good) + len(reasons) == raw.count()


def test_strict_cleaning_fails_on_a_bad_value_but_not_on_a_missing_one(spark):
    missing = spark.createDataFrame([("1", "2", "3.0", "4"), (None, "2", "3.0", "4")], RAW)
    assert ingest.clean_ratings(missing, strict=True).count() == 1
    bad = spark.createDataFrame([("1", "2", "3.0", "4"), ("1", "2", "bad", "4")], RAW)
    with pytest.raises(Exception, match="UNREADABLE_RATING"):
        ingest.clean_ratings(bad, strict=True).collect()


def test_conform_columns_needs_all_columns(spark):
    odd = spark.createDataFrame([("1", "2", "3", "4")], " USERID string, movieid string, Rating string, timestamp string")
    assert ingest.conform_columns(odd).columns == ["userId", "movieId", "rating", "timestamp"]
    lacking = ingest.conform_columns(odd.drop("Rating"))
    assert lacking.columns == ["userId", "movieId", "rating", "timestamp"]
    assert lacking.isEmpty()


def test_ratings_file_must_exist_and_have_rows(spark, tmp_path):
    with pytest.raises(Exception):
        files.load_raw_ratings(spark, str(tmp_path / "nowhere")).count()
    empty = tmp_path / "empty.csv"
    empty.write_text("userId,movieId,rating,timestamp\n")
    with pytest.raises(ValueError):
        files.load_raw_ratings(spark, str(empty))
    unusable = tmp_path / "unusable.csv"
    unusable.write_text("userId,movieId,rating,timestamp\n1,2,9.0,4\n")
    with pytest.raises(ValueError):
        files.load_ratings(spark, str(unusable))


def test_csv_reading(spark, tmp_path):
    file = tmp_path / "ratings.csv"
    file.write_text('userId,movieId,rating,timestamp\n1,2,3.0,4\n,2,3.0,4\ntoo,few\n1,2,3.0,4,extra\n')
    got = rows(files.load_raw_ratings(spark, str(file)), F.col("userId").asc_nulls_last())
    assert got == [("1", "2", "3.0", "4"), (None, "2", "3.0", "4")]


def test_optional_files_give_typed_empty_tables(spark, tmp_path):
    assert files.load_movies(spark, str(tmp_path / "none")).dtypes == [
        ("movieId", "int"), ("title", "string"), ("genres", "string")
    ]
    assert files.load_tags(spark, None).isEmpty()


def test_csv_round_trip_keeps_quotes_and_commas(spark, tmp_path):
    movies = spark.createDataFrame([("1", 'A "quoted", title', "X|Y")], files.MOVIES_SCHEMA)
    path = str(tmp_path / "movies")
    files.write_csv(movies, path)
    assert rows(files.load_movies(spark, path), "movieId") == [(1, 'A "quoted", title', "X|Y")]


def test_genres_array(spark):
    movies = spark.createDataFrame(
        [(1, "a", "A| B ||C"), (2, "b", None), (3, "c", "  "), (4, "d", "(no genres listed)"), (5, "e", "|")],
        "movieId int, title string, genres string",
    )
    got = {r.movieId: r.genres for r in ingest.movie_genres_array(movies).collect()}
    assert got == {1: ["A", "B", "C"], 2: [], 3: [], 4: [], 5: []}


def test_movie_lookup(spark):
    movies = spark.createDataFrame([(1, "a", "A")], "movieId int, title string, genres string")
    wanted = spark.createDataFrame([(1,), (1,), (2,)], "movieId int")
    assert rows(ingest.movie_lookup_batch(movies, wanted), "movieId") == [(1, True, "a", ["A"]), (2, False, None, None)]


def test_prediction_pairs_skip_header_and_bad_lines(spark, tmp_path):
    file = tmp_path / "pairs.csv"
    file.write_text("userId,movieId\n1,100\n 2 , 200 \nx,3\n4\n\n5,6,7\n")
    assert rows(files.load_prediction_pairs(spark, str(file)), "userId") == [(1, 100), (2, 200), (5, 6)]


def test_header_names_decide_the_columns(spark, tmp_path):
    (tmp_path / "r.csv").write_text("MovieId, userid ,Rating,timestamp\n20,1,4.5,100\n")
    row = files.load_ratings(spark, str(tmp_path / "r.csv")).first()
    assert (row.userId, row.movieId, row.ratingActual) == (1, 20, 4.5)
    (tmp_path / "m.csv").write_text("movieId,name\n1,x\n")
    assert files.load_movies(spark, str(tmp_path / "m.csv")).count() == 0


def test_each_file_of_a_folder_has_its_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("userId,movieId,rating,timestamp\n1,10,4.0,100\n")
    (tmp_path / "b.csv").write_text("movieId,userId,rating,timestamp\n200,2,3.5,200\n")
    (tmp_path / "c.csv").write_text("timestamp,extra,rating,movieid,UserId\n300,x,1.5,30,3\n")
    (tmp_path / "d.csv").write_text("userId,rating,timestamp\n4,1.0,400\n")
    (tmp_path / "e.csv").write_text("")
    found = files.load_ratings(spark, str(tmp_path)).collect()
    assert sorted((r.userId, r.movieId, r.ratingActual, r.timestampEpochSeconds) for r in found) == [
        (1, 10, 4.0, 100), (2, 200, 3.5, 200), (3, 30, 1.5, 300)
    ]
