import numpy as np
import pytest

from rateframe.operators import vector_index, vectors

ITEMS = "itemId int, features array<float>"


def clustered(n, d, clusters, spread, seed):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((clusters, d))
    return centres[draw.integers(0, clusters, n)] + spread * draw.standard_normal((n, d))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype("float32"))], ITEMS).repartition(4).persist()


def neighbours(found):
    return {(r.itemId, r.neighborId) for r in found.collect()}


def test_few_candidates_and_high_recall(spark):
    items = frame(spark, clustered(5000, 64, 120, 0.7, 1))
    index = vector_index.build_index(items)
    compared = vector_index.candidates(index, items.withColumnRenamed("itemId", "queryId")).toPandas()["n"]
    assert len(compared) == 5000 and compared.sum() < 0.1 * 5000**2
    exact = neighbours(vectors.item_similar_items(items, 5))
    near = vector_index.similar_items(index, items, 5)
    assert len(neighbours(near) & exact) > 0.9 * len(exact)
    assert {r["rank"] for r in near.collect()} == {1, 2, 3, 4, 5}


def test_data_without_clusters_is_searched_in_more_lists(spark):
    items = frame(spark, np.random.default_rng(2).standard_normal((600, 32)))
    index = vector_index.build_index(items)
    lists = index.models.first()
    assert 1 < lists.probes < len(lists.lists)
    exact = neighbours(vectors.item_similar_items(items, 5))
    assert len(neighbours(vector_index.similar_items(index, items, 5)) & exact) > 0.9 * len(exact)


def test_a_stored_index_answers_alike(spark, tmp_path):
    items = frame(spark, clustered(400, 8, 20, 0.3, 3))
    index = vector_index.build_index(items)
    index.save(str(tmp_path / "index"))
    queries = frame(spark, clustered(30, 8, 20, 0.3, 4)).withColumnRenamed("itemId", "queryId")
    again = vector_index.load_index(spark, str(tmp_path / "index"))
    rows = [sorted(map(tuple, vector_index.search(i, queries, 4).collect())) for i in (index, again)]
    assert rows[0] == rows[1] and len(rows[0]) == 120


def test_a_list_with_most_items_is_split(spark):
    x = clustered(300, 6, 1, 0.05, 5)
    items = frame(spark, np.vstack([x, clustered(100, 6, 10, 0.3, 6)]))
    exact = neighbours(vectors.item_similar_items(items, 5))
    found = vector_index.item_similar_items_ann(items, 5, block_rows=30)
    assert len(neighbours(found) & exact) > 0.9 * len(exact)


def test_vectors_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [1.0, 2.0, 3.0])]
    items = spark.createDataFrame(rows, ITEMS)
    assert neighbours(vector_index.item_similar_items_ann(items, 3)) == {(1, 2), (2, 1)}
    assert vector_index.item_similar_items_ann(items.limit(0), 3).count() == 0


def test_a_query_is_sent_once_per_block_and_not_once_per_list(spark):
    """With each of its lists in the block that holds it, and in all blocks of a list that is split."""
    model = {"lists": np.random.default_rng(7).standard_normal((40, 4)).tolist(), "probes": 30}
    blocks_of = [[i // 20] for i in range(39)] + [[1, 2]]
    unit = np.random.default_rng(8).standard_normal((25, 4))
    rows = spark.createDataFrame([(i, v.tolist(), v.tolist()) for i, v in enumerate(unit)], "queryId int, features array<float>, unit array<double>")
    schema = "queryId int, features array<float>, block int, lists array<int>"
    sent = rows.mapInArrow(vector_index._lists_by_block(model, blocks_of), schema).collect()
    assert len(sent) == len({(r.queryId, r.block) for r in sent}) <= 3 * 25
    nearest = vector_index._with_lists(rows, model, 30, "queryId").collect()
    wanted = {(r.queryId, b, x) for r in nearest for x in r.lists for b in blocks_of[x]}
    assert {(r.queryId, r.block, x) for r in sent for x in r.lists} == wanted


def test_the_length_of_a_vector_is_counted_once_a_row(spark):
    """And not in the function that divides each number of the vector by it."""
    plan = vector_index._comparable(spark.createDataFrame([(1, [3.0, 4.0])], ITEMS), "itemId")
    assert [round(x, 9) for x in plan.first().unit] == [0.6, 0.8]
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "as double) / lambda" in optimized and "/ SQRT(aggregate" not in optimized


def test_the_fit_of_the_centroids_has_several_parts(spark, monkeypatch):
    fitted = []

    class Fit:
        def __init__(self, **_):
            pass

        def fit(self, sample):
            fitted.append((len(sample.inputFiles()), sample.count()))
            return self

        def clusterCenters(self):
            return [[1.0, 0.0], [0.0, 1.0]]

    monkeypatch.setattr(vector_index, "KMeans", Fit)
    monkeypatch.setattr(vector_index, "FIT_PART_ROWS", 50, raising=False)
    x = frame(spark, np.random.default_rng(9).standard_normal((400, 2)))
    rows = vector_index._comparable(x, "itemId")
    assert len(vector_index._centroids(rows, 400, 2, 42)) == 2
    assert fitted == [(8, 400)]
