"""The training job: split, train, evaluate, store model, factors and recommendations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rateframe.operators import als, serving, vectors
from rateframe.session import materialize
from rateframe.sources.keyed_store import KeyedStore


def recommendation_store(spark: SparkSession, path: str) -> KeyedStore:
    """Recommendation documents that training jobs keep in ``path``."""
    return KeyedStore(spark, f"{path}/recommendations", "userId")


def run_training(
    ratings: DataFrame,
    movies: DataFrame | None,
    config: als.AlsConfig,
    generated_at_micros: int,
    model_version: str,
    path: str,
    top: int = 10,
) -> dict[str, object]:
    """Train on clean ratings and write ``path``/model, /factors and /recommendations.

    A user's new recommendations replace the stored ones; users the model does not know keep theirs.
    Everything large goes from executors to files; only the error measure returns to the driver.
    """
    train, test = als.train_test_split(materialize(ratings, "training-ratings"), config)
    model = als.als_train(train, config)
    rmse = als.als_rmse(model, test)
    als.save_model(model, f"{path}/model")
    vectors.factor_table(
        als.user_factors_of(model), als.item_factors_of(model), generated_at_micros, model_version
    ).write.mode("overwrite").parquet(f"{path}/factors")
    incoming = serving.recs_enriched(als.als_recommend_all(model, top), movies, generated_at_micros, model_version)
    recommendation_store(ratings.sparkSession, path).upsert(incoming, serving.recs_upsert)
    return {"rmse": rmse, "model_version": model_version, "path": path}
