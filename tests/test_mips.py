import numpy as np
import pytest
from pyspark.sql import functions as F

from rateframe.operators import als, mips

USERS, ITEMS = "userId int, features array<float>", "itemId int, features array<float>"


def vectors(n, d, seed, skew=0.0):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((n, d)) * np.exp(skew * draw.standard_normal((n, 1)))
    return x.astype("float32")


def frames(spark, users, items):
    return (
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(users)], USERS),
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], ITEMS).repartition(3),
    )


def brute_force(users, items, k):
    score = users.astype("float64") @ items.astype("float64").T
    order = np.lexsort((np.broadcast_to(np.arange(len(items)), score.shape), -score), axis=1)[:, :k]
    return {u: row.tolist() for u, row in enumerate(order)}


def lists(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.userId, r["rank"])):
        out.setdefault(r.userId, []).append(r.itemId)
    return out


@pytest.mark.parametrize("block_items,block_users", [(4096, 16384), (25, 40)])
def test_equals_brute_force(spark, monkeypatch, block_items, block_users):
    monkeypatch.setattr(mips, "BLOCK_USERS", block_users)
    users, items = vectors(120, 6, 1), vectors(400, 6, 2, skew=0.5)
    found, counts = mips.top_products(*frames(spark, users, items), 7, block_items)
    assert lists(found) == brute_force(users, items, 7)
    assert counts["compared"] <= counts["all"]


def test_long_vectors_end_the_scan_early(spark, monkeypatch):
    monkeypatch.setattr(mips, "BLOCK_USERS", 50)
    users, items = vectors(200, 8, 3), vectors(2000, 8, 4, skew=1.2)
    found, counts = mips.top_products(*frames(spark, users, items), 5, 50)
    assert lists(found) == brute_force(users, items, 5)
    assert counts["all"] >= 160 and counts["compared"] < 0.5 * counts["all"]


def test_users_who_are_done_are_not_dealt_again(spark, monkeypatch):
    """One user in 20 has to look at every block; the others end with the first one."""
    monkeypatch.setattr(mips, "BLOCK_USERS", 20)
    users = np.tile(np.array([[1.0, 0.0]], "float32"), (200, 1))
    users[::20] = [0.0, 1.0]
    lengths = np.linspace(2, 1, 400, dtype="float32")
    items = np.stack([lengths, np.zeros(400, "float32")], axis=1)
    items[::40] = np.stack([np.zeros(10, "float32"), lengths[::-40]], axis=1) / 10
    items[:40, 0], items[40::40, 0] = 3, 0.1
    found, counts = mips.top_products(*frames(spark, users, items), 5, 40)
    assert lists(found) == brute_force(users, items, 5)
    assert counts == {"all": 100, "compared": counts["compared"]} and counts["compared"] <= 10 + 9


def test_ties_bad_vectors_other_dimensions_and_few_items(spark):
    items = spark.createDataFrame(
        [(5, [1.0, 0.0]), (3, [1.0, 0.0]), (9, [0.0, 1.0]), (1, None), (2, []), (4, [float("nan"), 1.0]), (8, [1.0, 1.0, 1.0]), (7, [0.0, 0.0])], ITEMS
    )
    users = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, -1.0]), (3, None), (4, [1.0]), (5, [0.0, 0.0]), (6, [0.0, 0.0, 2.0])], USERS)
    assert lists(mips.top_products(users, items, 3)[0]) == {1: [3, 5, 7], 2: [7, 3, 5], 5: [3, 5, 7], 6: [8]}
    assert mips.top_products(users.limit(0), items, 3)[0].count() == 0
    assert mips.top_products(users, items.limit(0), 3)[0].count() == 0


def test_same_lists_as_the_library(spark):
    draw = np.random.default_rng(6)
    rows = [(int(u), int(i), float(r)) for u, i, r in zip(draw.integers(1, 60, 1500), draw.integers(1, 90, 1500), draw.integers(1, 11, 1500) / 2)]
    rated = spark.createDataFrame(rows, "userId int, movieId int, ratingActual double")
    model = als.als_train(rated, als.AlsConfig(rank=5, max_iter=4, seed=3))
    mine = {r.userId: [(x.movieId, round(x.rating, 4)) for x in r.recommendations] for r in als.als_recommend_all(model, 6).collect()}
    theirs = model.recommendForAllUsers(6).select("userId", F.col("recommendations").cast("array<struct<movieId:int,rating:float>>").alias("r"))
    assert mine == {r.userId: [(x.movieId, round(x.rating, 4)) for x in r.r] for r in theirs.collect()}


def test_searches_share_the_blocks_of_a_model(spark, monkeypatch):
    rows = [(u, i, float((u * i) % 9 + 1) / 2) for u in range(1, 31) for i in range(1, 41) if (u + i) % 4]
    model = als.als_train(spark.createDataFrame(rows, "userId int, movieId int, ratingActual double"), als.AlsConfig(rank=3, max_iter=2, seed=3))
    blocks, labels, keep = als.item_blocks_of(model), [], mips.materialize
    monkeypatch.setattr(mips, "materialize", lambda df, label: (labels.append(label), keep(df, label))[1])
    some = als.als_recommend_subset(model, spark.createDataFrame([(3,), (3,), (8,), (99,)], "userId int"), 5, blocks)
    every = als.als_recommend_all(model, 5, blocks)
    assert "asking-users" in labels and not {"item-lengths", "item-blocks", "numbered-blocks"} & set(labels)
    lists_of = lambda df: {r.userId: r.recommendations for r in df.collect()}
    assert sorted(lists_of(some)) == [3, 8] and lists_of(some).items() <= lists_of(every).items() and len(lists_of(every)) == 30


def test_no_plan_pairs_all_rows(spark, monkeypatch):
    plans = []
    keep = mips.materialize
    monkeypatch.setattr(mips, "materialize", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), keep(df, label))[1])
    found, _ = mips.top_products(*frames(spark, vectors(60, 4, 7), vectors(300, 4, 8)), 5, 40)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("CartesianProduct" in p or "NestedLoop" in p for p in plans)


def test_blocks_follow_the_number_of_cores(spark):
    assert als.AlsConfig().blocks is None and als.AlsConfig(blocks=3).blocks == 3
