import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rateframe.operators import vectors

ITEMS = "itemId int, features array<float>"


def brute(asked, offered, k, same=False):
    def unit(rows):
        m = np.array([v for _, v in rows], dtype="float32").astype("float64")
        return m / np.where(np.linalg.norm(m, axis=1) == 0, 1, np.linalg.norm(m, axis=1))[:, None]

    cosine = np.round(unit(asked) @ unit(offered).T, vectors.COSINE_DIGITS)
    out = set()
    for i, (query, _) in enumerate(asked):
        order = sorted(range(len(offered)), key=lambda j: (-cosine[i, j], offered[j][0]))
        order = [j for j in order if not (same and offered[j][0] == query)][:k]
        out |= {(query, rank, offered[j][0]) for rank, j in enumerate(order, 1)}
    return out


def random_vectors(n, dim=6, seed=1):
    return [(i + 1, [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(seed).normal(size=(n, dim)))]


@pytest.mark.parametrize("block_rows", [7, 40, 100000])
def test_item_neighbours_are_exact_for_any_block_size(spark, block_rows):
    rows = random_vectors(90)
    found = vectors.item_similar_items(spark.createDataFrame(rows, ITEMS), 4, block_rows).collect()
    assert {(r.itemId, r.rank, r.neighborId) for r in found} == brute(rows, rows, 4, same=True)


def test_a_third_of_equal_vectors_stays_exact(spark):
    rows = random_vectors(60)
    rows = [(i, rows[0][1] if i % 3 == 0 else v) for i, v in rows]
    found = vectors.item_similar_items(spark.createDataFrame(rows, ITEMS), 5, 8).collect()
    assert {(r.itemId, r.rank, r.neighborId) for r in found} == brute(rows, rows, 5, same=True)


def test_users_against_items_with_more_asked_than_there_are(spark):
    users, items = random_vectors(10, seed=2), random_vectors(3, seed=3)
    found = vectors.user_similar_items(
        spark.createDataFrame(users, "userId int, features array<float>"), spark.createDataFrame(items, ITEMS), 5, 5.0, 2
    ).collect()
    assert {(r.userId, r.rank, r.movieId) for r in found} == brute(users, items, 5)
    assert all(r.score == pytest.approx(min(5.0, r.cosine * 10)) for r in found)


def test_unusable_and_odd_vectors_are_no_candidates(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0, 0.0, 0.0])]
    found = vectors.nearest_items(spark.createDataFrame(rows, ITEMS), 3).collect()
    assert {(r.queryId, r.itemId) for r in found} == {(1, 1), (1, 2), (2, 2), (2, 1), (6, 6)}


def test_many_vector_lengths(spark):
    rows = [(10 * n + i, [float(i + 1)] + [1.0] * n) for n in range(5) for i in range(2)]
    found = vectors.nearest_items(spark.createDataFrame(rows, ITEMS), 2).collect()
    assert {(r.queryId, r.itemId) for r in found} == {(10 * n + i, 10 * n + j) for n in range(5) for i in range(2) for j in range(2)}


def test_validation_reasons(spark):
    rows = [
        (1, [1.0, 2.0, 3.0]), (2, [0.0, -1.0, 100.5]), (3, None), (4, []),
        (5, [float("nan")]), (6, [float("inf")]), (7, [float("-inf"), 1.0]), (8, [None]),
    ]
    got = {r.itemId: r.reason for r in vectors.vector_validation(spark.createDataFrame(rows, ITEMS)).collect()}
    assert got == {
        3: "NULL_VECTOR", 4: "EMPTY_VECTOR", 5: "NON_FINITE_VALUE", 6: "NON_FINITE_VALUE",
        7: "NON_FINITE_VALUE", 8: "NON_FINITE_VALUE",
    }


def test_factor_bytes_are_little_endian_floats_and_round_trip(spark):
    users = spark.createDataFrame([(123, [1.0, 2.0, 3.0]), (124, None), (125, [])], "userId int, features array<float>")
    items = spark.createDataFrame([(456, [float(i) for i in range(1000)])], ITEMS)
    stored = vectors.factor_table(users, items, 7, "v1")
    got = {r.key: r for r in vectors.decode_factors(stored).collect()}
    assert set(got) == {"vector:user:123", "vector:item:456"}
    assert bytes(got["vector:user:123"].vector) == np.array([1, 2, 3], dtype="<f4").tobytes()
    assert len(got["vector:item:456"].vector) == 4000 and got["vector:item:456"].dimension == 1000
    assert got["vector:item:456"].features == [float(i) for i in range(1000)]


@pytest.mark.parametrize("blob", [b"", b"abcde"])
def test_bytes_that_are_no_floats_are_an_error(spark, blob):
    stored = spark.createDataFrame([("k", bytearray(blob))], "key string, vector binary")
    with pytest.raises(Exception, match="not whole floats"):
        vectors.decode_factors(stored).collect()


def test_neighbour_lists_are_ordered(spark):
    rows = random_vectors(30)
    lists = vectors.neighbor_lists(spark.createDataFrame(rows, ITEMS), 5, 9).collect()
    assert len(lists) == 30
    for r in lists:
        assert [n.rank for n in r.neighbors] == [1, 2, 3, 4, 5]
        assert r.neighbors[0].movieId == r.seedId
        assert [n.cosine for n in r.neighbors] == sorted((n.cosine for n in r.neighbors), reverse=True)


def test_what_a_search_sends_grows_with_its_vectors_and_blocks_stay_bounded(spark):
    sizes = [4000, 40_000, 400_000, 615_000]
    rows = spark.createDataFrame([(n, 64) for n in sizes], "n bigint, dimension int")
    blocks = [r.b for r in rows.select("n", vectors.block_count(F.col("n"), F.col("dimension"), None).alias("b")).orderBy("n").collect()]
    assert blocks == [1, 8, 8, 10]
    assert all(n / b * 64 <= vectors.BLOCK_NUMBERS for n, b in zip(sizes, blocks))


def test_scores_that_can_be_among_the_best(monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK_CELLS", 50)
    assert max(s.stop - s.start for s in vectors._shares_of(1000, 7)) * 7 <= 50
    draw = np.random.default_rng(5)
    for n, keep in ((1, 1), (5, 5), (300, 4), (1000, 10)):
        scores = np.round(draw.standard_normal((20, n)), 1)
        found = set(zip(*(x.tolist() for x in vectors.at_least_kth(scores, keep))))
        kth = np.sort(scores, axis=1)[:, -keep]
        assert {(r, c) for r in range(20) for c in range(n) if scores[r, c] >= kth[r]} <= found


def test_lists_of_seeds_are_those_among_all(spark):
    items = spark.createDataFrame([(i, np.random.default_rng(i).standard_normal(6).tolist()) for i in range(60)], ITEMS)
    seeds = spark.createDataFrame([(3,), (3,), (17,), (None,), (999,)], "movieId int")
    every = {r.seedId: r.neighbors for r in vectors.neighbor_lists(items, 4).collect()}
    some = {r.seedId: r.neighbors for r in vectors.neighbor_lists(items, 4, seeds=seeds).collect()}
    assert some == {i: every[i] for i in (3, 17)}


def block(x, ids, **lists):
    x = np.asarray(x, dtype="float32")
    ends = np.arange(0, x.size + 1, x.shape[1], dtype="int32")
    features = pa.chunked_array([pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()))])
    return pa.table({**{name: pa.array(v, pa.int32()) for name, v in ids.items()}, "features": features, **lists})


def dealt(n, lists, probes, seed, d=16):
    """Queries that look into some of the lists, and items in lists."""
    draw = np.random.default_rng(seed)
    x, list_of = draw.standard_normal((n, d)), draw.integers(0, lists, n)
    wanted = pa.chunked_array([pa.array([draw.permutation(lists)[:probes].tolist() for _ in range(n)], pa.list_(pa.int32()))])
    return x, list_of, block(x, {"queryId": np.arange(n)}, lists=wanted), block(x, {"itemId": np.arange(n)}, list=pa.array(list_of, pa.int32()))


@pytest.mark.parametrize("cells, again", [(1 << 22, 0), (1500, 0), (1 << 22, 40), (1500, 40)])
def test_items_of_the_lists_asked_for_are_found_and_no_others(monkeypatch, cells, again):
    """In one part or many, and with the first items there twice, as other vectors in other lists."""
    monkeypatch.setattr(vectors, "CHUNK_CELLS", cells)
    x, list_of, queries, items = dealt(400, 12, 5, 1)
    ids = np.concatenate([np.arange(400 - again), np.arange(again)])
    items = items.set_column(0, "itemId", pa.array(ids, pa.int32()))
    found = vectors._nearest_in_block(4, 9)(queries, items)
    unit = x.astype("float32").astype("float64")
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    cosine = np.round(unit @ unit.T, 9)
    wanted = set()
    for q, lists in enumerate(queries["lists"].to_pylist()):
        best = {}
        for i in np.nonzero(np.isin(list_of, lists))[0]:
            best[int(ids[i])] = max(best.get(int(ids[i]), -2.0), cosine[q, i])
        wanted |= {(q, i) for i, _ in sorted(best.items(), key=lambda b: (-b[1], b[0]))[:4]}
    assert set(zip(found["queryId"].to_pylist(), found["itemId"].to_pylist())) == wanted and found.num_rows == 1600


def test_copies_of_a_row_take_no_place_of_other_items():
    x, list_of, queries, items = dealt(200, 4, 2, 2)
    search = vectors._nearest_in_block(4, 9)
    assert search(queries, pa.concat_tables([items] * 3)).equals(search(queries, items))


def test_a_search_by_lists_costs_little_more_than_one_of_all():
    """Not k items, sorted, for each query and list."""
    _, _, queries, items = dealt(4000, 100, 100, 3)

    def seconds(*tables):
        began = time.perf_counter()
        vectors._nearest_in_block(6, 9)(*tables)
        return time.perf_counter() - began

    by_lists, of_all = (min(seconds(*t) for _ in range(3)) for t in ((queries, items), (queries.drop("lists"), items.drop("list"))))
    assert by_lists < 10 * of_all
