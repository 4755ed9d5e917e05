"""Latent factor tables, vector checks and nearest-neighbour search.

Search never joins items to items as rows. Vectors are dealt into blocks of bounded size,
each pair of blocks is one Spark group, and a group hands back only the k nearest per query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateframe.fixed_values import FLOAT_BYTES, VECTOR_KEY_PREFIX
from rateframe.functions.expressions import vector_problem, weighted_score

LEAST_BLOCKS = 8
SMALL_BLOCK = 4096
BLOCK_NUMBERS = 1 << 22  # in the vectors of a block
CHUNK_CELLS = 1 << 22
SEGMENT = 64  # items at most
PANEL, PANEL_QUERIES = 256, 1024  # items and queries that are multiplied at a time: their products stay in the cache
NONE = -4.0  # below any cosine
COSINE_DIGITS = 9
NEAREST = "queryId int, itemId int, cosine double"


# --- factor tables ------------------------------------------------------------

def _bytes_of_vectors() -> Callable:
    def to_bytes(vectors):
        import numpy as np
        import pyarrow as pa

        values = vectors.flatten().to_numpy(zero_copy_only=False).astype("<f4")
        lengths = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int64") * 4
        return pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(vectors), [None, pa.py_buffer(ends), pa.py_buffer(values.tobytes())]
        ).cast(pa.binary())

    return F.arrow_udf(to_bytes, "binary")


def _vectors_of_bytes() -> Callable:
    def to_vectors(blobs):
        import numpy as np
        import pyarrow as pa

        lengths = np.array([len(b) for b in blobs.to_pylist()], dtype="int64") // 4
        joined = b"".join(blobs.to_pylist())
        values = np.frombuffer(joined, dtype="<f4").astype("float32")
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype("int32")
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))

    return F.arrow_udf(to_vectors, "array<float>")


def factor_rows(
    factors: DataFrame, id_column: str, entity_type: str, generated_at: int, model_version: str
) -> DataFrame:
    """Factors of one kind in stored form; null and empty vectors are skipped."""
    usable = factors.filter(F.col("features").isNotNull() & (F.size("features") > 0))
    entity = F.col(id_column).cast("string")
    return usable.select(
        F.concat(F.lit(f"{VECTOR_KEY_PREFIX}:{entity_type}:"), entity).alias("key"),
        F.col(id_column).cast("int").alias("entity_id"),
        F.lit(entity_type).alias("entity_type"),
        F.size("features").alias("dimension"),
        _bytes_of_vectors()(F.col("features").cast("array<float>")).alias("vector"),
        F.lit(generated_at).cast("bigint").alias("timestamp"),
        F.lit(model_version).alias("model_version"),
    )


def factor_table(
    user_factors: DataFrame, item_factors: DataFrame, generated_at: int, model_version: str
) -> DataFrame:
    return factor_rows(user_factors, "userId", "user", generated_at, model_version).unionByName(
        factor_rows(item_factors, "itemId", "item", generated_at, model_version)
    )


def decode_factors(stored: DataFrame) -> DataFrame:
    """Stored vectors as float arrays; bytes that are not whole floats are an error."""
    whole = (F.length("vector") > 0) & (F.length("vector") % FLOAT_BYTES == 0)
    checked = F.when(whole, F.col("vector")).otherwise(
        F.raise_error(F.concat(F.lit("vector bytes are not whole floats: "), F.col("key"))).cast("binary")
    )
    return stored.withColumn("features", _vectors_of_bytes()(checked))


def vector_validation(factors: DataFrame, id_column: str = "itemId") -> DataFrame:
    """Vectors that cannot be stored, with the reason."""
    return (
        factors.select(
            id_column,
            F.coalesce(F.size("features"), F.lit(0)).alias("dimension"),
            vector_problem("features").alias("reason"),
        )
        .filter(F.col("reason").isNotNull())
    )


# --- exact search ---------------------------------------------------------------

def _shares_of(rows: int, items: int) -> Iterator[slice]:
    """Slices of ``rows`` that meet ``items`` in a matrix of bounded size."""
    step = max(1, CHUNK_CELLS // max(items, 1))
    return (slice(first, first + step) for first in range(0, rows, step))


def at_least_kth(scores, keep: int, slack: float = 0.0):
    """(row, column) of all scores that can be among the ``keep`` best of their row, and maybe more.

    The kth best of the maxima of parts of a row is no better than the kth best of the row, and found in one pass.
    """
    import numpy as np

    rows, n = scores.shape
    parts = max(keep, min(n, 256))
    width = n // parts
    tops = scores[:, : parts * width].reshape(rows, parts, width).max(axis=2)
    return np.nonzero(scores >= np.partition(tops, -keep, axis=1)[:, -keep][:, None] - slack)


def _units(table):
    """Vectors of a table as rows of length 1; a vector of zeros stays."""
    import numpy as np

    flat = table["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(table.num_rows, -1).astype("float64")
    norm = np.sqrt(np.einsum("ij,ij->i", rows, rows))
    rows /= np.where(norm == 0.0, 1.0, norm)[:, None]
    return rows


def _best_of(found: dict, k: int, distinct: bool) -> dict:
    """The k best items of each query in order; each once, with its best cosine, if they are to be ``distinct``."""
    import numpy as np

    def cut(order, places):
        return {name: values[order][places] for name, values in found.items()}

    if distinct:
        order = np.lexsort((-found["cosine"], found["itemId"], found["queryId"]))
        q, i = found["queryId"][order], found["itemId"][order]
        found = cut(order, np.concatenate([[True], (q[1:] != q[:-1]) | (i[1:] != i[:-1])])[: len(q)])
    order = np.lexsort((found["itemId"], -found["cosine"], found["queryId"]))
    q = found["queryId"][order]
    return cut(order, np.arange(len(q)) - np.searchsorted(q, q) < k)


def _groups(table, listed: bool):
    """Rows of a table in the order of their groups and, in a group, of their id; and of each group its list, its first row,
    the row after its last, and whether its rows count: those of an id that another row has already do not.

    Without lists there is one group of all rows.
    """
    import numpy as np

    ids = table["itemId"].to_numpy()
    if not listed:
        return np.argsort(ids, kind="stable"), [(0, 0, len(ids), True)]
    lists, again = table["list"].to_numpy(), np.ones(len(ids), dtype=bool)
    again[np.unique(ids, return_index=True)[1]] = False
    order = np.lexsort((ids, again, lists))
    lists, again = lists[order], again[order]
    first = np.nonzero(np.concatenate([[True], (lists[1:] != lists[:-1]) | (again[1:] != again[:-1])])[: len(ids)])[0]
    ends = np.append(first[1:], len(ids))
    return order, [(int(lists[f]), int(f), int(e), not again[f]) for f, e in zip(first, ends)]


def _segments(groups: list, width: int):
    """Group, first row and end of each segment of at most ``width`` rows, none of which lies in two groups."""
    import numpy as np

    counts = np.array([-(-(end - first) // width) for _, first, end, _ in groups])
    group = np.repeat(np.arange(len(groups)), counts)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = np.array([g[1] for g in groups])[group] + nth * width
    return group, starts, np.minimum(starts + width, np.array([g[2] for g in groups])[group])


class _Best:
    """The k best items of each row of those that have come so far, in bounded room: by cosine and then id, and of rows of one
    id one if they are to be ``distinct``."""

    def __init__(self, rows: int, k: int, distinct: bool):
        self.rows, self.k, self.distinct = rows, k, distinct
        self.parts, self.size, self.kth = [], 0, None

    def add(self, row, item, cosine) -> None:
        if self.kth is not None:
            least, last = self.kth
            better = (cosine > least[row]) | ((cosine == least[row]) & (item < last[row]))
            row, item, cosine = row[better], item[better], cosine[better]
        self.parts.append((row, item, cosine))
        self.size += len(row)
        if self.size > CHUNK_CELLS // 4 + self.rows * self.k:
            self.cut()

    def cut(self) -> dict:
        import numpy as np

        none = (np.array([], dtype="int64"), np.array([], dtype="int64"), np.array([]))
        found = dict(zip(("queryId", "itemId", "cosine"), map(np.concatenate, zip(none, *self.parts))))
        found = _best_of(found, self.k, self.distinct)
        row, item, cosine = found.values()
        kth = np.arange(len(row)) - np.searchsorted(row, row) == self.k - 1
        least, last = np.full(self.rows, -np.inf), np.zeros(self.rows, dtype="int64")
        least[row[kth]], last[row[kth]] = cosine[kth], item[kth]
        self.parts, self.size, self.kth = [(row, item, cosine)], len(row), (least, last)
        return found


def _askers(lists, groups: list, rows: int) -> list:
    """The rows of queries that look into each group; all rows where queries have no lists."""
    import numpy as np

    if lists is None:
        return [np.arange(rows)] * len(groups)
    lists = lists.combine_chunks()
    looked, asker = lists.flatten().to_numpy(), np.repeat(np.arange(rows), lists.value_lengths().to_numpy())
    by_list = np.argsort(looked, kind="stable")
    looked, asker = looked[by_list], asker[by_list]
    return [asker[slice(*np.searchsorted(looked, [at, at + 1]))] for at, *_ in groups]


def _nearest_in_block(k: int, digits: int) -> Callable:
    """Nearest items of a block of queries in a block of items: of all of them or, where queries have ``lists`` and items a
    ``list``, of those in the lists that a query looks into.

    Items lie in short segments. Products of half the digits give the best cosine in each segment; the kth best of these, less
    what such products can be wrong by, is no better than the kth best item. Only segments that reach it are compared in full.
    """

    def nearest(queries, candidates):
        import numpy as np
        import pyarrow as pa

        listed = "lists" in queries.column_names
        kinds = {"queryId": "int32", "itemId": "int32", "cosine": "float64"}
        found = {name: [np.array([], dtype=kind)] for name, kind in kinds.items()}
        if queries.num_rows and candidates.num_rows:
            query_ids, asked = queries["queryId"].to_numpy(), _units(queries)
            order, groups = _groups(candidates, listed)
            item_ids, items = candidates["itemId"].to_numpy()[order], _units(candidates)[order]
            width = int(np.clip(len(items) // (4 * max(k, len(groups))), 1, SEGMENT))
            group, starts, ends = _segments(groups, width)
            # A segment that is not full repeats its last item, which leaves its best as it is.
            padded = np.minimum(starts[:, None] + np.arange(width), ends[:, None] - 1)
            light_items, light_asked = items[padded.ravel()].astype("float32"), asked.astype("float32")
            counts = np.array([g[3] for g in groups])[group]
            first = np.searchsorted(group, np.arange(len(groups) + 1))
            # A cosine of d rounded numbers is wrong by (d + 2) / 2**24 at most; twice that leaves room for rounding the bar.
            slack = 2 * ((asked.shape[1] + 2) * 2.0**-23 + 10.0**-digits)
            step = max(1, PANEL // width)
            for some in _shares_of(len(asked), len(group)):
                part, light = asked[some], light_asked[some]
                tops = np.full((len(part), len(group)), NONE, dtype="float32")
                for at, who in enumerate(_askers(queries["lists"][some] if listed else None, groups, len(part))):
                    for few in (who[x : x + PANEL_QUERIES] for x in range(0, len(who), PANEL_QUERIES)):
                        turned = np.ascontiguousarray(light[few].T)
                        for s in range(first[at], first[at + 1], step):
                            e = min(s + step, first[at + 1])
                            cosine = light_items[s * width : e * width] @ turned
                            tops[few, s:e] = cosine.reshape(e - s, width, len(few)).max(axis=1).T
                bar = np.full(len(part), NONE / 2)
                sure = tops if counts.all() else tops[:, counts]
                if sure.shape[1] >= k:
                    bar = np.maximum(bar, np.partition(sure, -k, axis=1)[:, -k].astype("float64") - slack)
                row, segment = np.divmod(np.flatnonzero(tops >= bar.astype("float32")[:, None]), len(group))
                by_segment = np.argsort(segment, kind="stable")
                row, segment = row[by_segment], segment[by_segment]
                place = np.searchsorted(segment, np.arange(len(group) + 1))
                best = _Best(len(part), k, distinct=listed)
                for s in np.unique(segment):
                    who, mine = row[place[s] : place[s + 1]], slice(starts[s], ends[s])
                    cosine = part[who] @ items[mine].T
                    i, j = np.divmod(np.flatnonzero(cosine >= bar[who][:, None]), cosine.shape[1])
                    best.add(who[i], item_ids[mine][j], np.round(cosine[i, j], digits))
                near = best.cut()
                found["queryId"].append(query_ids[some][near["queryId"]])
                found["itemId"].append(near["itemId"])
                found["cosine"].append(near["cosine"])
        found = {name: np.concatenate(parts).astype(kinds[name]) for name, parts in found.items()}
        return pa.table(_best_of(found, k, distinct=True) if listed else found)

    return nearest


def block_count(n: Column, dimension: Column, block_rows: int | None) -> Column:
    """Blocks that n vectors are dealt to. Without ``block_rows`` there are LEAST_BLOCKS, so that what is sent grows with n and
    not with its square; fewer for few vectors, and more once a block would pass BLOCK_NUMBERS."""
    if block_rows is not None:
        return F.ceil(n / block_rows).cast("int")
    most = F.greatest(F.lit(256), F.lit(BLOCK_NUMBERS) / dimension)
    return F.greatest(F.ceil(n / most), F.least(F.lit(LEAST_BLOCKS), F.ceil(n / SMALL_BLOCK))).cast("int")


def _blocks(sizes: DataFrame, block_rows: int | None, name: str) -> DataFrame:
    return sizes.withColumn(name, block_count(F.col("n"), F.col("dimension"), block_rows)).drop("n")


def nearest_first(near: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query, with their rank: by cosine and then itemId."""
    order = Window.partitionBy("queryId").orderBy(F.desc("cosine"), "itemId")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def blocked_nearest(queries: DataFrame, candidates: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """The k nearest candidates by cosine for every query of the same dimension.

    ``queries`` has queryId and features, ``candidates`` itemId and features. Blocks are dealt by a
    hash of the id. The order is cosine (to 9 digits) and then itemId, in blocks and overall, so the result is exact.
    """

    def usable(df: DataFrame) -> DataFrame:
        return df.filter(vector_problem("features").isNull()).withColumn("dimension", F.size("features"))

    asked, offered = usable(queries), usable(candidates)
    asked_sizes = _blocks(asked.groupBy("dimension").agg(F.count("*").alias("n")), block_rows, "queryBlocks")
    offered_sizes = _blocks(offered.groupBy("dimension").agg(F.count("*").alias("n")), block_rows, "itemBlocks")
    # One small row per vector dimension, so never more rows than the longest vector has numbers. Joined by shuffle, it
    # would send all vectors of one dimension to one task.
    sizes = F.broadcast(asked_sizes.join(offered_sizes, "dimension"))
    pair = ["dimension", "queryBlock", "itemBlock"]
    dealt = (
        asked.join(sizes, "dimension")
        .withColumn("queryBlock", F.pmod(F.xxhash64("queryId"), F.col("queryBlocks")).cast("int"))
        .withColumn("itemBlock", F.explode(F.sequence(F.lit(0), F.col("itemBlocks") - 1)))
        # New names for the same columns: queries and candidates may come from one table.
        .select(*[F.col(c).alias(c) for c in (*pair, "queryId", "features")])
    )
    offers = (
        offered.join(sizes, "dimension")
        .withColumn("itemBlock", F.pmod(F.xxhash64("itemId"), F.col("itemBlocks")).cast("int"))
        .withColumn("queryBlock", F.explode(F.sequence(F.lit(0), F.col("queryBlocks") - 1)))
        .select(*pair, "itemId", "features")
    )
    return nearest_first(compared(dealt, offers, pair, k), k)


def compared(queries: DataFrame, candidates: DataFrame, pair: list[str], k: int) -> DataFrame:
    """(queryId, itemId, cosine): the best k of each query in each pair of blocks."""
    return queries.groupBy(*pair).cogroup(candidates.groupBy(*pair)).applyInArrow(_nearest_in_block(k, COSINE_DIGITS), NEAREST)


def nearest_items(items: DataFrame, k: int, block_rows: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """For every item, or every one whose id is among ``seeds`` (movieId), its k nearest items, itself included."""
    asked = items.select(F.col("itemId").alias("queryId"), "features")
    if seeds is not None:
        asked = asked.join(seeds.select(F.col("movieId").alias("queryId")).distinct(), "queryId", "left_semi")
    return blocked_nearest(asked, items.select("itemId", "features"), k, block_rows=block_rows)


def item_similar_items(items: DataFrame, k: int, block_rows: int | None = None) -> DataFrame:
    """For every item its k nearest other items."""
    found = nearest_items(items, k + 1, block_rows).filter(F.col("queryId") != F.col("itemId"))
    order = Window.partitionBy("queryId").orderBy("rank")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("queryId").alias("itemId"), "rank", F.col("itemId").alias("neighborId"), "cosine")
    )


def user_similar_items(
    users: DataFrame, items: DataFrame, k: int, weight: float, block_rows: int | None = None
) -> DataFrame:
    """For every user vector the k nearest items, scored for an event of the given weight."""
    asked = users.select(F.col("userId").alias("queryId"), "features")
    found = blocked_nearest(asked, items.select("itemId", "features"), k, block_rows=block_rows)
    return found.select(
        F.col("queryId").alias("userId"),
        "rank",
        F.col("itemId").alias("movieId"),
        "cosine",
        weighted_score(F.col("cosine"), F.lit(weight)).alias("score"),
    )


def neighbor_lists(items: DataFrame, k: int, block_rows: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """One row per item, or per item among ``seeds`` (movieId): an array of its k nearest items (itself included), nearest first."""
    entry = F.struct("rank", F.col("itemId").alias("movieId"), "cosine")
    return (
        nearest_items(items, k, block_rows, seeds)
        .groupBy(F.col("queryId").alias("seedId"))
        .agg(F.array_sort(F.collect_list(entry)).alias("neighbors"))
    )
