"""Exact top-k inner products by a vector-approximation file.

Every dimension is cut into cells between its least and largest value; a vector's approximation is its cell
numbers, one byte each. A scan of the approximations gives, for each query, an upper and a lower bound of
every score. Candidates are those whose upper bound reaches the kth best lower bound. Exact vectors are then
read in bound order: the best bounds first, which fixes a kth exact score, and then only the
candidates whose upper bound can still reach it, until the result is certain.

Queries and approximations meet in blocks of bounded size, which hand on candidates only. Of equal
vectors only the k + 1 smallest ids can be among the k best (one may be the query), so the rest
is left out before the scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateframe.llm.textops import collect_bounded
from rateframe.session import materialize

CELLS = 256
BLOCK_QUERIES = 2048
BLOCK_VECTORS = 16384
FIRST_READ = 16
MOST_DIMENSIONS = 65536


def whole_numbers(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component as a double; null if the vector or a component is null or not finite."""
    values = F.transform(vector, lambda x: x.cast("double"))
    usable = vector.isNotNull() & F.forall(values, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    return F.when(usable, F.transform(values, lambda x: F.floor(x * scale).cast("long")))


def _rows(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1)


def _bounds(k: int, low: dict[int, np.ndarray], width: dict[int, np.ndarray]):
    """Candidates of a block of queries in a block of approximations."""

    def scan(queries: pa.Table, approximations: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "lower": [], "upper": []}
        if queries.num_rows and approximations.num_rows:
            q, cells = _rows(queries["vector"], "float64"), _rows(approximations["cells"], "float64")
            query_id, vec_id = queries["query_id"].to_numpy(), approximations["vec_id"].to_numpy()
            d = q.shape[1]
            centre = low[d] + (cells + 0.5) * width[d]
            slack = np.abs(q) @ (0.5 * width[d])
            slack = slack * (1 + 1e-9) + 1e-6
            for first in range(0, len(q), 128):
                part = slice(first, first + 128)
                middle = q[part] @ centre.T
                middle[query_id[part][:, None] == vec_id[None]] = -np.inf
                # Within a query all bounds have one width, so the kth best lower bound is that of the kth middle.
                kth = np.partition(middle, -min(k, middle.shape[1]), axis=1)[:, -min(k, middle.shape[1])]
                reach = kth - slack[part] if middle.shape[1] >= k else np.full(len(kth), -np.inf)
                row, column = np.nonzero((middle + slack[part][:, None] >= reach[:, None]) & np.isfinite(middle))
                out["query_id"].append(query_id[part][row])
                out["vec_id"].append(vec_id[column])
                out["lower"].append(middle[row, column] - slack[part][row])
                out["upper"].append(middle[row, column] + slack[part][row])
        kinds = {"query_id": "int64", "vec_id": "int64", "lower": "float64", "upper": "float64"}
        return pa.table({c: np.concatenate(v).astype(kinds[c]) if v else np.zeros(0, kinds[c]) for c, v in out.items()})

    return scan


def top_k(vectors: DataFrame, is_query: Column, k: int, scale: int = 256, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row where ``is_query`` holds, the k rows of other ids with the largest inner product of
    ``floor(scale * x)`` components: query_id, rank from 1, vec_id, score. Ties go to the smaller vec_id.

    Rows without id, and vectors that are null, empty, or hold null or non-finite components, take no part.
    Equal rows count once; one id with several vectors has its best one listed, and asks with each (rank
    then counts over all of them). Vectors meet only those with as many components. Fewer than k others
    give fewer rows, an empty table none. Components are taken to be below 2 to the 30 after scaling.
    """
    numbers = whole_numbers(F.col(vector), scale)
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), numbers.alias("vector"), is_query.alias("asks"))
    rows = rows.filter("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    rows = materialize(rows.groupBy("vec_id", "vector").agg(F.max("asks").alias("asks")).withColumn("d", F.size("vector")), "vectors")

    queries = rows.filter("asks").select(F.col("vec_id").alias("query_id"), "vector", "d")
    same = Window.partitionBy("vector").orderBy("vec_id")
    offered = rows.select("vec_id", "vector", "d", F.row_number().over(same).alias("copy")).filter(F.col("copy") <= k + 1).drop("copy")
    offered = materialize(offered, "offered")

    ranges = offered.select("d", F.posexplode("vector").alias("i", "x")).groupBy("d", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    ranges = collect_bounded(ranges, MOST_DIMENSIONS).sort_by([("d", "ascending"), ("i", "ascending")]).to_pandas()
    if not len(ranges):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    low = {int(d): g["low"].to_numpy(dtype="float64") for d, g in ranges.groupby("d")}
    width = {int(d): (g["high"].to_numpy(dtype="float64") - g["low"].to_numpy(dtype="float64") + 1) / CELLS for d, g in ranges.groupby("d")}

    lows = F.create_map(*[x for d, v in low.items() for x in (F.lit(d), F.array(*map(F.lit, v.tolist())))])
    widths = F.create_map(*[x for d, v in width.items() for x in (F.lit(d), F.array(*map(F.lit, v.tolist())))])
    boxes = F.arrays_zip(F.col("vector").alias("x"), lows[F.col("d")].alias("low"), widths[F.col("d")].alias("width"))
    cells = F.transform(boxes, lambda b: F.floor((b["x"] - b["low"]) / b["width"]).cast("short"))
    n_vectors, n_queries = offered.count(), queries.count()
    vector_blocks, query_blocks = -(-n_vectors // BLOCK_VECTORS), max(1, -(-n_queries // BLOCK_QUERIES))
    asked = queries.select(
        "d", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("q"),
        F.explode(F.sequence(F.lit(0), F.lit(vector_blocks - 1))).alias("v"), "query_id", "vector",
    )
    approximations = offered.select(
        "d", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))).alias("q"),
        F.pmod(F.xxhash64("vec_id"), F.lit(vector_blocks)).cast("int").alias("v"), "vec_id", cells.alias("cells"),
    )
    found = asked.groupBy("d", "q", "v").cogroup(approximations.groupBy("d", "q", "v")).applyInArrow(
        _bounds(k, low, width), "query_id long, vec_id long, lower double, upper double"
    )
    found = materialize(found, "bounds")

    best_bounds = Window.partitionBy("query_id").orderBy(F.desc("lower"))
    reach = found.withColumn("n", F.row_number().over(best_bounds)).filter(F.col("n") <= k)
    reach = reach.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("lower")).alias("reach"))
    open_ = found.join(reach, "query_id").filter("reach IS NULL OR upper >= reach").drop("reach", "lower")
    in_order = Window.partitionBy("query_id").orderBy(F.desc("upper"), "vec_id")
    open_ = materialize(open_.withColumn("n", F.row_number().over(in_order)), "candidates")

    def exact(pairs: DataFrame) -> DataFrame:
        a = queries.select("query_id", F.col("vector").alias("a"))
        b = offered.select("vec_id", F.col("vector").alias("b"))
        product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
        read = pairs.join(a, "query_id").join(b, "vec_id").filter(F.size("a") == F.size("b"))
        return read.groupBy("query_id", "vec_id").agg(F.max(product).alias("score"))

    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    first = materialize(exact(open_.filter(F.col("n") <= FIRST_READ).select("query_id", "vec_id").distinct()), "first-read")
    certain = first.withColumn("n", F.row_number().over(by_score)).filter(F.col("n") <= k)
    certain = certain.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("kth"))
    later = open_.filter(F.col("n") > FIRST_READ).join(certain, "query_id").filter("kth IS NULL OR upper >= kth")
    later = later.select("query_id", "vec_id").distinct().join(first.select("query_id", "vec_id"), ["query_id", "vec_id"], "left_anti")
    later = materialize(exact(later), "later-read")
    ranked = first.union(later).withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int"), "vec_id", "score")
