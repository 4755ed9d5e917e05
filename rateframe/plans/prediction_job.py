"""The prediction job: a file of (userId, movieId) pairs and a stored model to a CSV of predicted ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rateframe.operators import als
from rateframe.session import materialize
from rateframe.sources import files

UNKNOWN_USER, UNKNOWN_MOVIE, UNKNOWN_BOTH = "UNKNOWN_USER", "UNKNOWN_MOVIE", "UNKNOWN_USER_AND_MOVIE"


def unknown_pairs(model, pairs: DataFrame) -> DataFrame:
    """Pairs that the model cannot predict, with the reason."""
    users = als.user_factors_of(model).select("userId", F.lit(True).alias("knownUser"))
    movies = als.item_factors_of(model).select(F.col("itemId").alias("movieId"), F.lit(True).alias("knownMovie"))
    joined = pairs.select("userId", "movieId").join(users, "userId", "left").join(movies, "movieId", "left")
    no_user, no_movie = F.col("knownUser").isNull(), F.col("knownMovie").isNull()
    reason = F.when(no_user & no_movie, UNKNOWN_BOTH).when(no_user, UNKNOWN_USER).when(no_movie, UNKNOWN_MOVIE)
    return joined.select("userId", "movieId", reason.alias("reason")).filter("reason IS NOT NULL")


def run_predictions(spark: SparkSession, model_path: str, pairs_path: str, path: str) -> dict[str, int]:
    """Writes ``path``/predictions (userId, movieId, prediction) and ``path``/unknown (userId, movieId, reason) as CSV with a
    header, and returns how many rows each has. Lines that are no pair are left out; repeated pairs are predicted as often."""
    model = als.load_model(model_path)
    pairs = materialize(files.load_prediction_pairs(spark, pairs_path), "prediction-pairs")
    outputs = {"predictions": als.als_predict(model, pairs), "unknown": unknown_pairs(model, pairs)}
    for name, df in outputs.items():
        files.write_csv(df, f"{path}/{name}")
    return {name: spark.read.option("header", True).csv(f"{path}/{name}").count() for name in outputs}
