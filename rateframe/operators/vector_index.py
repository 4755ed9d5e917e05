"""A stored index for approximate nearest neighbours: inverted lists over coarse centroids.

Spark's k-means on a bounded sample gives the centroids; every item is then stored in the list of its nearest one. A query
looks into the lists of its nearest centroids only. How many is measured when the index is built: a bounded sample of items
asks for its exact neighbours, and the index keeps the least number of lists that hold the wanted share of them, so data with
clusters are searched in few lists and data without in more. The index is written once and reused.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rateframe.functions.expressions import vector_problem
from rateframe.operators.vectors import NEAREST, block_count, blocked_nearest, compared, nearest_first
from rateframe.session import hold, materialize

FIT_ROWS = 100_000
FIT_PART_ROWS = 2048
CALIBRATION_ROWS = 256
CALIBRATION_NEIGHBORS = 10
TARGET = 0.97
MOST_LISTS = 16_384
CELLS = 1 << 20
MODELS = "dimension int, lists array<array<double>>, probes int"


@dataclass(frozen=True)
class VectorIndex:
    """Lists of items (dimension, list, itemId, features), and one model row per dimension: centroids and lists to probe."""

    items: DataFrame
    models: DataFrame

    def save(self, path: str) -> None:
        self.items.write.partitionBy("dimension").parquet(f"{path}/items")
        self.models.write.parquet(f"{path}/models")


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    return VectorIndex(spark.read.parquet(f"{path}/items"), spark.read.schema(MODELS).parquet(f"{path}/models"))


def _comparable(items: DataFrame, key: str) -> DataFrame:
    """Vectors with a direction, with that as unit vector."""
    length = F.sqrt(F.aggregate("features", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    rows = items.filter(vector_problem("features").isNull()).withColumn("length", length).filter("length > 0")
    # As an argument the length is counted once a row; named in the function it would be once for each number of the vector.
    unit = F.zip_with("features", F.array_repeat("length", F.size("features")), lambda x, s: x.cast("double") / s)
    return rows.select(key, "features", unit.alias("unit"), F.size("features").alias("dimension"))


def _near_lists(model: dict, count: int) -> Callable:
    """Of rows of unit vectors their ``count`` nearest lists, nearest first, for some rows at a time."""
    import numpy as np

    centroids = np.array(model["lists"])
    squares = (centroids**2).sum(axis=1)

    def near(batch):
        step = max(1, CELLS // len(centroids))
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            unit = part["unit"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
            distance = squares - 2 * unit @ centroids.T
            order = distance.argmin(axis=1)[:, None] if count == 1 else np.argsort(distance, axis=1, kind="stable")[:, :count]
            yield part, order.astype("int32")

    return near


def _lists_of(model: dict, count: int, key: str) -> Callable:
    """Each row with its ``count`` nearest lists, nearest first."""

    def lists(batches):
        import numpy as np
        import pyarrow as pa

        near = _near_lists(model, count)
        for batch in batches:
            for part, order in near(batch):
                ends = pa.array(np.arange(part.num_rows + 1, dtype="int32") * order.shape[1])
                columns = [part[key], part["features"], pa.ListArray.from_arrays(ends, pa.array(order.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "features", "lists"])

    return lists


def _lists_by_block(model: dict, blocks_of: list[list[int]]) -> Callable:
    """Each query once per block that holds one of its nearest lists, with those of its lists that the block holds."""

    def deal(batches):
        import numpy as np
        import pyarrow as pa

        near = _near_lists(model, model["probes"])
        held = np.array([len(b) for b in blocks_of])
        start, blocks = np.cumsum(held) - held, np.array([b for bs in blocks_of for b in bs], dtype="int32")
        for batch in batches:
            for part, order in near(batch):
                lists = order.ravel()
                row, times = np.repeat(np.arange(part.num_rows), order.shape[1]), held[lists]
                row, lists = np.repeat(row, times), np.repeat(lists, times)
                block = blocks[start[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)]
                by_block = np.lexsort((block, row))
                row, lists, block = row[by_block], lists[by_block], block[by_block]
                first = np.nonzero(np.diff(row, prepend=-1) | np.diff(block, prepend=-1))[0]
                ends = pa.array(np.append(first, len(row)).astype("int32"))
                columns = [
                    part["queryId"].take(pa.array(row[first])), part["features"].take(pa.array(row[first])),
                    pa.array(block[first]), pa.ListArray.from_arrays(ends, pa.array(lists)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["queryId", "features", "block", "lists"])

    return deal


def _with_lists(rows: DataFrame, model: dict, count: int, key: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(_lists_of(model, count, key), f"{key} {kinds[key]}, features {kinds['features']}, lists array<int>")


def _centroids(items: DataFrame, n: int, lists: int | None, seed: int) -> list[list[float]]:
    """Centres of the FIT_ROWS items with the smallest hash of their id."""
    sample = items.orderBy(F.xxhash64("itemId", F.lit(seed)), "itemId").limit(FIT_ROWS)
    # The limit leaves one part, which would be one task in every round of the fit.
    sample = sample.repartition(max(1, min(n, FIT_ROWS) // FIT_PART_ROWS))
    sample = materialize(sample.select(array_to_vector("unit").alias("unit")), "index-sample")
    k = lists or max(1, min(MOST_LISTS, round(n**0.5), FIT_ROWS // 8))
    if k < 2 or n < 4:
        return [[0.0] * items.first().dimension]
    model = KMeans(featuresCol="unit", k=k, seed=seed, maxIter=10, initMode="random").fit(sample)
    return [[float(x) for x in c] for c in model.clusterCenters()]


def _probes(items: DataFrame, stored: DataFrame, model: dict, target: float, block_rows: int | None) -> int:
    """The least number of nearest lists that hold ``target`` of the exact neighbours of a sample of items."""
    sample = items.orderBy(F.xxhash64("itemId"), "itemId").limit(CALIBRATION_ROWS)
    sample = materialize(sample, "calibration").withColumnRenamed("itemId", "queryId")
    near = blocked_nearest(sample.select("queryId", "features"), stored.select("itemId", "features"), CALIBRATION_NEIGHBORS + 1, block_rows=block_rows)
    near = near.filter("queryId != itemId").join(stored.select("itemId", "list"), "itemId")
    order = _with_lists(sample.select("queryId", "features", "unit"), model, len(model["lists"]), "queryId")
    place = F.array_position("lists", F.col("list"))
    places = near.join(order.select("queryId", "lists"), "queryId").groupBy(place.alias("place")).agg(F.count("*").alias("n"))
    counts = sorted((r.place, r.n) for r in hold(places, len(model["lists"])).collect())
    wanted, seen = target * sum(n for _, n in counts), 0
    for at, n in counts:
        seen += n
        if seen >= wanted:
            return int(at)
    return 1


def build_index(
    items: DataFrame, lists: int | None = None, target: float = TARGET, seed: int = 42, block_rows: int | None = None
) -> VectorIndex:
    """An index of items (itemId, features) for cosine. Vectors without a direction are left out.

    ``lists`` is the square root of the number of items by default, ``target`` the share of exact neighbours that the probed
    lists of the sample must hold. Each dimension has lists of its own.
    """
    spark = items.sparkSession
    rows = materialize(_comparable(items, "itemId"), "indexed-items")
    sizes = rows.groupBy("dimension").agg(F.count("*").alias("n")).orderBy("dimension").toLocalIterator()
    stored, models = None, []
    for size in sizes:
        mine = rows.filter(F.col("dimension") == size.dimension)
        model = {"dimension": size.dimension, "lists": _centroids(mine, size.n, lists, seed), "probes": 1}
        placed = _with_lists(mine.select("itemId", "features", "unit"), model, 1, "itemId")
        placed = placed.select(F.lit(size.dimension).alias("dimension"), F.col("lists")[0].alias("list"), "itemId", "features")
        placed = materialize(placed, "inverted-lists")
        model["probes"] = _probes(mine, placed, model, target, block_rows)
        stored = placed if stored is None else stored.union(placed)
        models.append((model["dimension"], model["lists"], model["probes"]))
    if stored is None:
        kind = items.schema["itemId"].dataType.simpleString()
        stored = spark.createDataFrame([], f"dimension int, list int, itemId {kind}, features array<float>")
    return VectorIndex(stored, spark.createDataFrame(models, MODELS))


def _dealt_lists(index: VectorIndex, models: list, block_rows: int | None) -> tuple[dict, DataFrame]:
    """Blocks that hold each list, by dimension; and the items with their block.

    Lists lie one after the other in blocks of about equal size, and one that is larger than a block in several. A block per
    list would send a query once for each list that it looks into, which are more the more items there are.
    """
    most = sum(len(m.lists) for m in models)
    sizes = index.items.groupBy("dimension", "list").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("dimension")
    sizes = sizes.withColumn("all", F.sum("n").over(whole))
    sizes = sizes.withColumn("rows", F.col("all") / block_count(F.col("all"), F.col("dimension"), block_rows))
    pieces = F.ceil(F.col("n") / F.col("rows"))
    before = F.sum("n").over(whole.orderBy("list")) - F.col("n")
    at = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.floor((before + i * F.col("n") / pieces) / F.col("rows")).cast("int"))
    places = hold(sizes.select("dimension", "list", at.alias("blocks")), most)
    blocks = {m.dimension: [[] for _ in m.lists] for m in models}
    for r in places.collect():
        blocks[r.dimension][r.list] = sorted(set(r.blocks))
    # As many rows as there are lists.
    dealt = index.items.join(F.broadcast(places), ["dimension", "list"])
    mine = F.element_at("blocks", F.pmod(F.xxhash64("itemId"), F.size("blocks")).cast("int") + 1)
    return blocks, dealt.withColumn("block", mine).drop("blocks")


def search(index: VectorIndex, queries: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """(queryId, itemId, cosine, rank): the k nearest items of each query (queryId, features) in the lists it looks into."""
    rows = materialize(_comparable(queries, "queryId"), "index-queries")
    models = list(index.models.toLocalIterator())
    blocks, items = _dealt_lists(index, models, block_rows)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    asked = None
    for m in models:
        mine = rows.filter(F.col("dimension") == m.dimension).select("queryId", "features", "unit")
        deal = _lists_by_block({"lists": m.lists, "probes": m.probes}, blocks[m.dimension])
        found = mine.mapInArrow(deal, f"queryId {kind['queryId']}, features {kind['features']}, block int, lists array<int>")
        found = found.withColumn("dimension", F.lit(m.dimension))
        asked = found if asked is None else asked.union(found)
    if asked is None:
        return nearest_first(queries.sparkSession.createDataFrame([], NEAREST), k)
    # One row per dimension.
    counts = rows.groupBy("dimension").agg(F.count("*").alias("n"))
    parts = F.broadcast(counts.select("dimension", block_count(F.col("n"), F.col("dimension"), block_rows).alias("parts")))
    dealt = asked.join(parts, "dimension").withColumn("part", F.pmod(F.xxhash64("queryId"), F.col("parts")).cast("int"))
    offers = items.join(parts, "dimension").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pair = ["dimension", "block", "part"]
    near = compared(dealt.select(*pair, "queryId", "features", "lists"), offers.select(*pair, "itemId", "features", "list"), pair, k)
    return nearest_first(near.groupBy("queryId", "itemId").agg(F.max("cosine").alias("cosine")), k)


def _rows_met(model: dict, sizes: list[int]) -> Callable:
    """How many items the nearest lists of each query hold."""

    def met(batches):
        import numpy as np
        import pyarrow as pa

        near, held = _near_lists(model, model["probes"]), np.array(sizes, dtype="int64")
        for batch in batches:
            for part, order in near(batch):
                yield pa.RecordBatch.from_arrays([part["queryId"], pa.array(held[order].sum(axis=1))], names=["queryId", "n"])

    return met


def candidates(index: VectorIndex, queries: DataFrame) -> DataFrame:
    """(queryId, n): how many items each query is compared with."""
    rows = _comparable(queries, "queryId")
    kind = rows.schema["queryId"].dataType.simpleString()
    models = list(index.models.toLocalIterator())
    counts = index.items.groupBy("dimension", "list").agg(F.count("*").alias("n"))
    sizes = {m.dimension: [0] * len(m.lists) for m in models}
    for r in hold(counts, sum(len(m.lists) for m in models)).collect():
        sizes[r.dimension][r.list] = r.n
    found = queries.sparkSession.createDataFrame([], f"queryId {kind}, n bigint")
    for m in models:
        mine = rows.filter(F.col("dimension") == m.dimension)
        met = mine.mapInArrow(_rows_met({"lists": m.lists, "probes": m.probes}, sizes[m.dimension]), f"queryId {kind}, n bigint")
        found = found.union(met.filter("n > 0"))
    return found.groupBy("queryId").agg(F.sum("n").alias("n"))


def similar_items(index: VectorIndex, queries: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """For each of ``queries`` (itemId, features) its k nearest other items."""
    asked = queries.select(F.col("itemId").alias("queryId"), "features")
    found = search(index, asked, k + 1, block_rows).filter(F.col("queryId") != F.col("itemId"))
    order = Window.partitionBy("queryId").orderBy("rank")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("queryId").alias("itemId"), "rank", F.col("itemId").alias("neighborId"), "cosine")


def item_similar_items_ann(items: DataFrame, k: int, block_rows: int | None = None, **options) -> DataFrame:
    """For every item its k nearest other items, by an index built for this search."""
    return similar_items(build_index(items, block_rows=block_rows, **options), items, k, block_rows)
