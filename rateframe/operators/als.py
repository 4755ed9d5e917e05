"""Collaborative filtering with MLlib's ALS."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.operators import mips
from rateframe.operators.ingest import require_rows
from rateframe.session import shared_dir


@dataclass(frozen=True)
class AlsConfig:
    rank: int = 50
    max_iter: int = 15
    reg_param: float = 0.1
    alpha: float = 1.0
    implicit: bool = False
    seed: int = 12345
    train_share: float = 0.8
    # Blocks that users and items are dealt to; by default one per core that the session has.
    blocks: int | None = None
    checkpoint_interval: int = 5


def train_test_split(ratings: DataFrame, config: AlsConfig) -> tuple[DataFrame, DataFrame]:
    """Seeded random split. Pass stored ratings: a split is only repeatable over fixed files."""
    train, test = ratings.randomSplit([config.train_share, 1 - config.train_share], seed=config.seed)
    return require_rows(train, "training rows"), test


def als_train(train: DataFrame, config: AlsConfig) -> ALSModel:
    context = train.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(train.sparkSession))
    blocks = config.blocks or max(context.defaultParallelism, 1)
    return ALS(
        rank=config.rank,
        maxIter=config.max_iter,
        regParam=config.reg_param,
        alpha=config.alpha,
        implicitPrefs=config.implicit,
        seed=config.seed,
        numUserBlocks=blocks,
        numItemBlocks=blocks,
        checkpointInterval=config.checkpoint_interval,
        userCol="userId",
        itemCol="movieId",
        ratingCol="ratingActual",
        coldStartStrategy="drop",
    ).fit(train)


def als_rmse(model: ALSModel, test: DataFrame) -> float | None:
    """Root mean squared error, or None when there is nothing to compare."""
    if not {"userId", "movieId", "ratingActual"} <= set(test.columns):
        return None
    miss = F.col("ratingActual") - F.col("prediction")
    return model.transform(test).agg(F.sqrt(F.avg(miss * miss))).first()[0]


def als_predict(model: ALSModel, pairs: DataFrame) -> DataFrame:
    """Predicted rating per (userId, movieId); ids the model does not know are left out."""
    return model.transform(pairs.select("userId", "movieId"))


def item_blocks_of(model: ALSModel) -> DataFrame:
    """The stored items of a model, for several searches over it."""
    return mips.item_blocks(item_factors_of(model))


def _lists(users: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """One array per user, best first; as long as k or the number of items."""
    found, _ = mips.top_products_of(users, blocks, k)
    entry = F.struct("rank", F.col("itemId").alias("movieId"), F.col("score").cast("float").alias("rating"))
    listed = F.array_sort(F.collect_list(entry))
    rows = found.groupBy("userId").agg(listed.alias("recommendations"))
    return rows.select("userId", F.transform("recommendations", lambda r: F.struct(r["movieId"].alias("movieId"), r["rating"].alias("rating"))).alias("recommendations"))


def als_recommend_all(model: ALSModel, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    return _lists(user_factors_of(model), blocks if blocks is not None else item_blocks_of(model), k)


def als_recommend_subset(model: ALSModel, users: DataFrame, k: int = 10, blocks: DataFrame | None = None) -> DataFrame:
    """Lists of those of ``users`` that the model knows."""
    wanted = users.select("userId").distinct()
    return _lists(user_factors_of(model).join(wanted, "userId", "left_semi"), blocks if blocks is not None else item_blocks_of(model), k)


def save_model(model: ALSModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> ALSModel:
    return ALSModel.load(path)


def user_factors_of(model: ALSModel) -> DataFrame:
    return model.userFactors.select(F.col("id").alias("userId"), "features")


def item_factors_of(model: ALSModel) -> DataFrame:
    return model.itemFactors.select(F.col("id").alias("itemId"), "features")
