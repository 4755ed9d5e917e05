"""Near-duplicate embeddings by product quantisation over inverted lists.

Equal vectors are one representative. Representatives are scaled to length 1; cosine >= c is then distance <= r with
r * r = 2 - 2c. A coarse codebook deals them to inverted lists by nearest centroid, and per subspace a codebook
of residuals turns a vector into one byte each. Both are fitted on a bounded sample; all vectors are indexed.

Probes. Two vectors of different lists lie on either side of the plane halfway between the centroids. Each vector is
dealt to all borders from whose plane it is at most ``margin`` * r away, and to its own list. A pair within r meets in
exactly one list or border unless its difference points across that plane by more than ``margin`` * r. Pairs
closer than that are never lost, and with margin 1 none is. A difference without preferred direction has a share of about
1 / sqrt(d) of its length across the plane, so the margin is twice that, a quarter at least.

Within a list or border, distances of exact vectors to codes come from lookup tables. A code is off by the known error e
of its vector, so pairs with a table distance up to r + e are candidates and none is lost here. Their cosines in double
precision decide. Lists of any size are compared in blocks, and only counts and one link per vector leave a block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.llm.components import components
from rateframe.llm.textops import collect_bounded, map_batches
from rateframe.session import materialize

SAMPLE_ROWS = 16384
SAMPLE_NUMBERS = 1 << 23
MOST_LISTS = 4096
SUBSPACES = 16
CODEWORDS = 256
KMEANS_ROUNDS = 8
MODELS = 8
LEAST_FOR_LISTS = 256
BLOCK_ROWS = 4096
TABLE_ROWS = 256
MARGIN = 0.25
FOUND = "rep long, n long, root long"


@dataclass(frozen=True)
class Codebooks:
    """Coarse centroids (lists, d) and per subspace its dimensions and codewords of residuals."""

    centroids: np.ndarray
    parts: tuple[np.ndarray, ...]
    words: tuple[np.ndarray, ...]

    def stacked(self) -> tuple[np.ndarray, np.ndarray]:
        """Per subspace the dimensions (subspaces, w), d where it has fewer than others, and the codewords
        (subspaces, words, w), zero there."""
        width, most = max(map(len, self.parts)), max(map(len, self.words))
        places = np.full((len(self.parts), width), self.centroids.shape[1])
        words = np.zeros((len(self.parts), most, width))
        for m, (p, w) in enumerate(zip(self.parts, self.words)):
            places[m, : len(p)] = p
            words[m, : len(w), : len(p)] = w
        return places, words


def _units(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    """``n`` vectors of one length, none zero, scaled to length 1 in double precision."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(n, -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


# --- fitting --------------------------------------------------------------------

def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre of every row, a bounded number of rows at a time."""
    sizes = (centres**2).sum(axis=1)
    step = max(1, (1 << 22) // len(centres))
    return np.concatenate([(sizes - 2 * x[i : i + step] @ centres.T).argmin(axis=1) for i in range(0, len(x), step)])


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """At most ``k`` centres; one that loses all its rows moves to a row far from its own."""
    draw = np.random.default_rng(seed)
    different = np.unique(x, axis=0)
    centres = different[draw.permutation(len(different))[:k]].copy()
    for _ in range(KMEANS_ROUNDS):
        near = _nearest(x, centres)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        far = np.argsort(-((x - centres[near]) ** 2).sum(axis=1), kind="stable")
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
        lost = np.nonzero(count == 0)[0]
        centres[lost] = x[far[: len(lost)]]
    return centres


def _fit(x: np.ndarray, lists: int) -> Codebooks:
    centroids = _kmeans(x, lists, 1)
    residual = x - centroids[_nearest(x, centroids)]
    parts = tuple(p for p in np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1])))
    return Codebooks(centroids, parts, tuple(_kmeans(residual[:, p], CODEWORDS, 2) for p in parts))


def codebooks(kinds: DataFrame, sizes: dict[int, int]) -> dict[int, Codebooks]:
    """Codebooks of the given vector lengths, from the SAMPLE_ROWS vectors of each with the smallest hash of their id."""
    books = {}
    for d, n in sizes.items():
        rows = max(CODEWORDS, min(SAMPLE_ROWS, SAMPLE_NUMBERS // d))
        sample = kinds.filter(F.col("d") == d).orderBy(F.xxhash64("rep"), "rep").limit(rows).select("v")
        sample = collect_bounded(sample, rows)["v"]
        x = _units(sample, len(sample))
        books[d] = _fit(x, max(1, min(MOST_LISTS, round(n**0.5 / 2), len(x) // 16)))
    return books


# --- indexing -------------------------------------------------------------------

def usual_margin(d: int) -> float:
    return min(1.0, max(MARGIN, 2 / d**0.5))


def _encode(books: dict[int, Codebooks], margin: float | None, radius: float):
    """Home list, borders from whose planes a vector is near enough, residual codes and their errors."""

    def encode(batches):
        for batch in batches:
            lengths = batch["d"].to_numpy()
            for d in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == d))
                n = part.num_rows
                book = books.get(d)
                if book is None:  # a length of few vectors: one list, no codes
                    columns = [pa.array(np.zeros(n, "int32")), pa.array([[]] * n, pa.list_(pa.int32())), pa.array([b""] * n, pa.binary()), pa.array(np.zeros(n))]
                else:
                    x = _units(part["v"], n)
                    home = _nearest(x, book.centroids)
                    own = book.centroids[home]
                    squares = (book.centroids**2).sum(axis=1)
                    far = squares - 2 * x @ book.centroids.T
                    apart = np.sqrt(np.maximum(squares[home][:, None] + squares - 2 * own @ book.centroids.T, 0))
                    reach = radius * (usual_margin(d) if margin is None else margin)
                    near = far - far[np.arange(n), home][:, None] <= 2 * reach * apart + 1e-9
                    near[np.arange(n), home] = False
                    row, border = np.nonzero(near)
                    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype("int32")
                    residual = x - own
                    codes = np.stack([_nearest(residual[:, p], w) for p, w in zip(book.parts, book.words)], axis=1)
                    error = np.sqrt(sum(((residual[:, p] - w[codes[:, m]]) ** 2).sum(axis=1) for m, (p, w) in enumerate(zip(book.parts, book.words))))
                    columns = [
                        pa.array(home.astype("int32")), pa.ListArray.from_arrays(pa.array(ends), pa.array(border.astype("int32"))),
                        pa.array([c.tobytes() for c in codes.astype("uint8")], pa.binary()), pa.array(error),
                    ]
                yield pa.RecordBatch.from_arrays(
                    [part["rep"], part["copies"], part["d"], *columns, part["v"]],
                    names=["rep", "copies", "d", "list", "borders", "codes", "error", "v"],
                )

    return encode


# --- comparing blocks ---------------------------------------------------------------

def _candidates(
    queries: np.ndarray, centroid: np.ndarray, stacked: tuple[np.ndarray, np.ndarray], codes: np.ndarray, limit: np.ndarray
) -> np.ndarray:
    """Which queries (rows) are within ``limit`` (a squared distance) of which codes (columns) by table lookups."""
    places, words = stacked
    residual = np.zeros((len(queries), queries.shape[1] + 1))
    residual[:, :-1] = queries - centroid
    parts = residual[:, places].transpose(1, 0, 2)
    tables = (parts**2).sum(axis=2)[:, :, None] - 2 * parts @ words.transpose(0, 2, 1) + (words**2).sum(axis=2)[:, None, :]
    tables = tables.astype("float32")
    total = np.zeros((len(queries), len(codes)), dtype="float32")
    for m, table in enumerate(tables):
        total += table[:, codes[:, m]]
    return total <= limit[None]


def _compare(books: dict[int, Codebooks], least: float, radius: float):
    """Links within one block of a list or border: per vector how many vectors it links to and one link that
    joins all vectors linked here, directly or not."""

    def compare(rows: pa.Table) -> pa.Table:
        rep, copies = rows["rep"].to_numpy(), rows["copies"].to_numpy()
        lists, left, right = (rows[c].to_numpy() for c in ("list", "left", "right"))
        d, low, high, a, b = (rows[c][0].as_py() for c in ("d", "low", "high", "a", "b"))
        # The sides of a block: two lists, or two parts of one list, or one part with itself.
        first = np.nonzero((lists == low) & (left == a))[0]
        second = first if low == high and a == b else np.nonzero((lists == high) & (right == b))[0]
        n, root = np.zeros(len(rep), dtype="int64"), rep.copy()
        if len(first) and len(second):
            unit = _units(rows["v"], len(rep))
            book = books.get(d)
            if book is not None:
                stacked = book.stacked()
                codes = np.frombuffer(b"".join(rows["codes"].to_pylist()), dtype="uint8").reshape(len(rep), -1)[second]
                limit = ((radius + rows["error"].to_numpy()[second]) ** 2 * (1 + 1e-5) + 1e-5).astype("float32")
            index = {}
            for begin in range(0, len(first), TABLE_ROWS):
                part = first[begin : begin + TABLE_ROWS]
                if book is None:
                    near = np.ones((len(part), len(second)), dtype=bool)
                else:
                    near = _candidates(unit[part], book.centroids[high], stacked, codes, limit)
                if second is first:
                    near &= rep[part][:, None] < rep[second][None]
                columns = np.nonzero(near.any(axis=0))[0]
                if len(columns):
                    cosine = unit[part] @ unit[second[columns]].T
                    linked = near[:, columns] & (cosine >= least)
                    np.add.at(n, part, linked @ copies[second[columns]])
                    np.add.at(n, second[columns], copies[part] @ linked)
                    index[begin] = (part, second[columns], np.packbits(linked, axis=1))
            changed = True
            while changed:  # smallest id over links until nothing changes
                changed = False
                for part, other, packed in index.values():
                    linked = np.unpackbits(packed, axis=1, count=len(other)).astype(bool)
                    big = np.iinfo("int64").max
                    low_part = np.minimum(root[part], np.where(linked, root[other][None], big).min(axis=1))
                    changed |= bool((low_part < root[part]).any())
                    root[part] = low_part
                    low_other = np.minimum(root[other], np.where(linked, root[part][:, None], big).min(axis=0))
                    changed |= bool((low_other < root[other]).any())
                    root[other] = low_other
        some = n > 0
        return pa.table({"rep": rep[some], "n": n[some], "root": root[some]})

    return compare


def _in_blocks(indexed: DataFrame) -> DataFrame:
    """Each vector in its list and borders, dealt to blocks: (low, high) the lists, (a, b) the parts of the sides.

    A side of more than BLOCK_ROWS vectors is cut into parts by a hash; each part meets each of the other side.
    """
    ways = F.concat(F.array("list"), "borders")
    rows = indexed.select("*", F.explode(ways).alias("other"))
    rows = rows.select("rep", "d", "list", F.least("list", "other").alias("low"), F.greatest("list", "other").alias("high"))
    key = ["d", "low", "high"]
    sizes = rows.groupBy(*key).agg(F.count_if(F.col("list") == F.col("low")).alias("lefts"), F.count_if(F.col("list") == F.col("high")).alias("rights"))
    parts = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    sizes = sizes.filter("lefts > 0 AND rights > 0 AND (low != high OR lefts > 1)").select(*key, parts("lefts").alias("lefts"), parts("rights").alias("rights"))
    sizes = materialize(sizes, "list-sizes")
    dealt = indexed.drop("borders").join(rows.select("rep", *key).distinct(), ["rep", "d"]).join(sizes, key)
    dealt = dealt.withColumn("left", F.pmod(F.xxhash64("rep"), "lefts").cast("int")).withColumn("right", F.pmod(F.xxhash64("rep"), "rights").cast("int"))
    one = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(F.least("left", i).alias("a"), F.greatest("left", i).alias("b")))
    lefts = F.transform(F.sequence(F.lit(0), F.col("rights") - 1), lambda i: F.struct(F.col("left").alias("a"), i.alias("b")))
    rights = F.transform(F.sequence(F.lit(0), F.col("lefts") - 1), lambda i: F.struct(i.alias("a"), F.col("right").alias("b")))
    blocks = F.when(F.col("low") == F.col("high"), one).when(F.col("list") == F.col("low"), lefts).otherwise(rights)
    return dealt.withColumn("block", F.explode(blocks)).select(*key, "block.a", "block.b", "rep", "copies", "list", "left", "right", "codes", "error", "v")


def near_duplicates(
    vectors: DataFrame, cosine: float = 0.9, margin: float | None = None, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """One row per row: vec_id, n_links (other rows linked with it directly), component_id (smallest vec_id reachable by
    links, itself included), kept (whether that is its own id).

    Rows link if their cosine in double precision is at least ``cosine`` (above 0). Vectors that are null, empty or zero, or hold null
    or non-finite components, link with nothing. Vectors of different lengths never link. Equal rows are linked
    rows. Of links between different vectors those are found that meet in a list or border (see ``margin`` above); none
    below ``cosine`` is returned. Rows of one id share the smallest component that any of them reaches. A row without id links with nothing, has a null
    component and is kept. An empty table gives no rows; other columns are not read.
    """
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(x))
    usable = F.col(id_column).isNotNull() & F.col(vector).isNotNull() & F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))
    kind = "float" if vectors.schema[vector].dataType.elementType.typeName() == "float" else "double"
    v = F.when(usable, F.transform(vector, lambda x: x.cast(kind)))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v"))
    reps = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"))
    # An id with several vectors names more than one representative, so they get numbers of their own.
    reps = materialize(reps.select(F.monotonically_increasing_id().alias("rep"), "first", "copies", F.size("v").alias("d"), "v"), "vector-kinds")
    large = reps.groupBy("d").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_FOR_LISTS).orderBy(F.desc("n"), "d").limit(MODELS)
    books = codebooks(reps, {r.d: r.n for r in large.collect()})
    radius = float(np.sqrt(2 - 2 * cosine))
    schema = f"rep long, copies long, d int, list int, borders array<int>, codes binary, error double, v array<{kind}>"
    indexed = materialize(map_batches(reps.select("rep", "copies", "d", "v"), _encode(books, margin, radius), schema), "indexed-vectors")
    found = _in_blocks(indexed).groupBy("d", "low", "high", "a", "b").applyInArrow(_compare(books, cosine, radius), FOUND)
    found = materialize(found, "vector-links")

    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    firsts = reps.select("rep", "first")
    linked = found.filter("rep != root").select("rep", "root").distinct()
    links = linked.join(firsts, "rep").select("root", F.col("first").alias("u")).join(firsts.withColumnRenamed("rep", "root"), "root").select("u", F.col("first").alias("v"))
    placed = materialize(rows.join(reps.join(counts, "rep", "left"), "v", "left").select("vec_id", "first", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")), "placed-vectors")
    # Rows of one kind or of one id are in one component.
    same = placed.filter("first != vec_id").select(F.col("vec_id").alias("u"), F.col("first").alias("v"))
    joined = components(links.union(same), "vector-components").withColumnRenamed("node", "vec_id")
    result = placed.join(joined, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
