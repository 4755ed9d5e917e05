"""Best inner products of many vectors with many items, without pairing all of them.

Items are kept in blocks in falling order of their length, |v|. As u.v <= |u| |v|, a user whose kth best score so far
reaches |u| times the longest vector of a block is done: no later item can enter the list. Blocks are scanned in
rounds of growing size. A round deals each user who is still open to those of its blocks that can matter, compares blocks of
users with blocks of items in one task each, and merges k rows per user. Users who are done leave with their rows, and those
who stay are dealt to fewer blocks of users, so later rounds cost what their few users cost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateframe.functions.expressions import vector_problem
from rateframe.operators.vectors import at_least_kth
from rateframe.session import hold, materialize

BLOCK_ITEMS = 4096
BLOCK_USERS = 16384
MOST_BLOCKS_A_ROUND = 512
MOST_TASKS_A_ROUND = 4096
SLACK = 1 + 1e-9


def _length(vector: str):
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _usable(df: DataFrame) -> DataFrame:
    rows = df.filter(vector_problem("features").isNull()).withColumn("features", F.col("features").cast("array<float>"))
    return rows.withColumn("length", _length("features")).withColumn("dimension", F.size("features"))


def _pack(block_items: int) -> Callable:
    """Rows in falling order of length to blocks of one dimension: one row with all ids and vectors."""

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        names = ["dimension", "longest", "ids", "vectors"]

        def block(rows):
            flat = rows["features"].combine_chunks().flatten()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([rows["dimension"][0].as_py()], pa.int32()), pa.array([rows["length"][0].as_py()], pa.float64()),
                    pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), rows["itemId"].combine_chunks()),
                    pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat),
                ],
                names=names,
            )

        held: dict[int, list] = {}
        for batch in batches:
            dimensions = batch["dimension"].to_numpy()
            for d in np.unique(dimensions).tolist():
                rows = pa.concat_tables([*held.pop(d, []), pa.Table.from_batches([batch.filter(pa.array(dimensions == d))])])
                while rows.num_rows >= block_items:
                    yield block(rows.slice(0, block_items))
                    rows = rows.slice(block_items)
                if rows.num_rows:
                    held[d] = [rows]
        for d in sorted(held):
            yield block(pa.concat_tables(held[d]))

    return pack


def item_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """Stored blocks (dimension, longest, ids, vectors, block) of items (itemId, features); those that cannot be compared
    are left out. Numbers of blocks rise within a dimension as ``longest`` falls."""
    rows = _usable(items).select("itemId", "dimension", "length", "features")
    # One file-backed copy, as a range shuffle reads its input twice.
    rows = materialize(rows.withColumn("itemId", F.col("itemId").cast("int")), "item-lengths")
    dealt = rows.repartitionByRange(F.desc("length"), "itemId").sortWithinPartitions(F.desc("length"), "itemId")
    packed = dealt.mapInArrow(_pack(block_items), "dimension int, longest double, ids array<int>, vectors array<float>")
    packed = materialize(packed.withColumn("part", F.monotonically_increasing_id()), "item-blocks")
    # Only the numbers of blocks are ordered here, one row per few thousand items.
    order = Window.partitionBy("dimension").orderBy(F.desc("longest"), "part")
    numbers = packed.select("part", F.row_number().over(order).alias("block"))
    return materialize(packed.join(numbers, "part").drop("part"), "numbered-blocks")


def _best_in_block(k: int) -> Callable:
    def best(users, blocks):
        import numpy as np
        import pyarrow as pa

        out = {"userId": [], "length": [], "itemId": [], "score": []}
        if users.num_rows and blocks.num_rows:
            ids = blocks["ids"].combine_chunks().flatten().to_numpy()
            asked = users["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(users.num_rows, -1)
            items = blocks["vectors"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(ids), -1)
            order = np.argsort(ids)
            ids, items = ids[order], items[order]
            user_ids, lengths, keep = users["userId"].to_numpy(), users["length"].to_numpy(), min(k, len(ids))
            for start in range(0, len(asked), 512):
                score = asked[start : start + 512] @ items.T
                row, column = at_least_kth(score, keep)
                value = score[row, column]
                ranked = np.lexsort((column, -value, row))
                row, column, value = row[ranked], column[ranked], value[ranked]
                first = np.arange(len(row)) - np.searchsorted(row, row) < keep
                out["userId"].append(user_ids[start + row[first]])
                out["length"].append(lengths[start + row[first]])
                out["itemId"].append(ids[column[first]])
                out["score"].append(value[first])
        kinds = {"userId": "int32", "length": "float64", "itemId": "int32", "score": "float64"}
        return pa.table({c: np.concatenate(v).astype(kinds[c]) if v else np.zeros(0, kinds[c]) for c, v in out.items()})

    return best


def _rounds(longest: list[float]) -> Iterator[tuple[int, int]]:
    """Ranges of block numbers, each three times as long as all before it: a round has a price of its own."""
    first = 1
    while first <= len(longest):
        last = min(first + min(max(3 * (first - 1), 1), MOST_BLOCKS_A_ROUND), len(longest) + 1)
        yield first, last
        first = last


def _search(asked: DataFrame, blocks: DataFrame, longest: list[float], k: int) -> tuple[DataFrame, int]:
    """Best rows of users of one dimension, and how many (user block, item block) pairs were compared."""
    open_ = asked.withColumn("kth", F.lit(None).cast("double"))
    left, done, compared = None, [], 0
    of_user = Window.partitionBy("userId")
    by_score = of_user.orderBy(F.desc("score"), "itemId")
    for first, last in _rounds(longest):
        lengths = F.array(*[F.lit(x) for x in longest[first - 1 : last - 1]])
        # Falling lengths: the blocks that can matter to a user come first. An open user needs one at least.
        needed = F.size(F.filter(lengths, lambda x: F.col("kth").isNull() | (x * F.col("length") * SLACK >= F.col("kth"))))
        parts = -(-open_.count() // BLOCK_USERS)
        if left is not None and not parts:
            break
        parts = max(parts, 1)
        asking = open_.withColumn("part", F.pmod(F.xxhash64("userId"), F.lit(parts)).cast("int")).withColumn("needed", needed)

        def upto(column: str):
            return F.explode(F.sequence(F.lit(first), F.lit(first - 1) + F.col(column))).alias("block")

        # One row per block of users, from which its pairs with blocks of items follow.
        wanted = hold(asking.groupBy("part").agg(F.max("needed").alias("most")), parts)
        met = sum(row.most for row in wanted.collect())
        compared += met
        # Dealt by number, as a pair of blocks is much work in few bytes.
        tasks = min(max(2 * met, 1), MOST_TASKS_A_ROUND)
        pairs = asking.select("part", upto("needed"), "userId", "length", "features").repartition(tasks, "part", "block")
        offers = wanted.select("part", upto("most")).join(blocks.filter(F.col("block").between(first, last - 1)), "block")
        found = pairs.groupBy("part", "block").cogroup(offers.repartition(tasks, "part", "block").groupBy("part", "block")).applyInArrow(
            _best_in_block(k), "userId int, length double, itemId int, score double"
        )
        found = found if left is None else left.union(found)
        best = found.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
        kth = F.when(F.max("rank").over(of_user) >= k, F.min("score").over(of_user))
        best = materialize(best.withColumn("kth", kth).drop("rank"), "best-so-far")
        if last > len(longest):
            done.append(best)
            break
        stays = F.col("kth").isNull() | (F.lit(longest[last - 1]) * F.col("length") * SLACK >= F.col("kth"))
        done.append(best.filter(~stays))
        staying = best.filter(stays)
        open_ = materialize(open_.drop("kth").join(staying.groupBy("userId").agg(F.min("kth").alias("kth")), "userId"), "open-users")
        left = staying.drop("kth")
    return reduce(DataFrame.union, done).select("userId", "itemId", "score"), compared


def top_products(users: DataFrame, items: DataFrame, k: int, block_items: int = BLOCK_ITEMS) -> tuple[DataFrame, dict[str, int]]:
    """(userId, itemId, score, rank): per user the k items of the largest inner product, ties to the smaller itemId; and how
    many pairs of a user block and an item block there are (``all``) and were compared (``compared``).

    ``users`` has userId, each once, and features; ``items`` itemId and features. Vectors that are null, empty or not finite
    take no part, and vectors meet only those of their dimension. The result is exact.
    """
    return top_products_of(users, item_blocks(items, block_items), k)


def top_products_of(users: DataFrame, blocks: DataFrame, k: int) -> tuple[DataFrame, dict[str, int]]:
    """:func:`top_products` over stored :func:`item_blocks`, which several groups of users can share."""
    asked = materialize(_usable(users).select(F.col("userId").cast("int").alias("userId"), "dimension", "length", "features"), "asking-users")
    heads: dict[int, list[float]] = {}
    for row in blocks.select("dimension", "longest").orderBy("dimension", F.desc("longest")).toLocalIterator():
        heads.setdefault(row.dimension, []).append(row.longest)
    best, counts = None, {"all": 0, "compared": 0}
    for d in sorted({r[0] for r in asked.select("dimension").distinct().collect()} & set(heads)):
        mine = asked.filter(F.col("dimension") == d).drop("dimension")
        found, compared = _search(mine, blocks.filter(F.col("dimension") == d).drop("dimension", "longest"), heads[d], k)
        counts["compared"] += compared
        counts["all"] += len(heads[d]) * -(-mine.count() // BLOCK_USERS)
        best = found if best is None else best.union(found)
    if best is None:
        best = users.sparkSession.createDataFrame([], "userId int, itemId int, score double")
    by_score = Window.partitionBy("userId").orderBy(F.desc("score"), "itemId")
    return best.withColumn("rank", F.row_number().over(by_score)), counts
