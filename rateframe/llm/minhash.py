"""Near-duplicates by one-permutation hashing.

A document's set is its distinct 5-word shingles. One hash deals the shingles into bins and the least in
each bin is kept; an empty bin borrows from the bin that its own fixed random order of bins finds first
(optimal densification). Bins are joined into bands, and documents that agree on a band share a bucket.

Equal sets are one representative from the start. Each bucket is a star: every member is paired with the
smallest one only, so pairs grow with the members. Pairs are confirmed on the full sets. A bucket with a
pair that is not confirmed may hold several groups. Its members are paired once more, with the member that
shares most buckets with others. What then is in a bucket with documents of other components is compared by
an exact rule: sets that overlap enough share one of their rarest shingles, so those are joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.llm.components import components
from rateframe.llm.textops import Words, map_batches, mix, shingle_hashes, text_slices
from rateframe.session import materialize

SHINGLE_WORDS = 5
BANDS = 32
ROWS = 4
_BINS = BANDS * ROWS
_EDGES = np.array([(k << 64) // _BINS for k in range(_BINS)], dtype="uint64")
_ORDERS = np.random.Generator(np.random.PCG64(20)).permuted(np.tile(np.arange(_BINS), (_BINS, 1)), axis=1).T


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least shingle of each bin, from sorted distinct hashes; empty bins borrow."""
    at = np.searchsorted(shingles, _EDGES)
    filled = np.diff(np.append(at, len(shingles))) > 0
    empty = np.nonzero(~filled)[0]
    source = np.arange(_BINS)
    if len(empty):
        orders = _ORDERS[:, empty]
        source[empty] = orders[np.argmax(filled[orders], axis=0), np.arange(len(empty))]
    return shingles[at[source]]


def band_hashes(minima: np.ndarray) -> np.ndarray:
    """One hash per band of a matrix of signatures."""
    bands = minima.reshape(len(minima), BANDS, ROWS)
    total = np.zeros(bands.shape[:2], dtype="uint64")
    for k in range(ROWS):
        total = mix(total * np.uint64(31) + bands[:, :, k])
    return total.view("int64")


def _distinct_shingles(words: Words) -> Iterator[np.ndarray]:
    for first, last in zip(words.first, words.first[1:]):
        yield np.unique(shingle_hashes(words.hash[first:last], SHINGLE_WORDS))


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "t"):
            sets = list(_distinct_shingles(Words(part.column("t"))))
            sizes = np.array([len(s) for s in sets], dtype="int64")
            sums = np.array([s.sum(dtype="uint64") if len(s) else 0 for s in sets], dtype="uint64").view("int64")
            folds = np.array([mix(s).sum(dtype="uint64") if len(s) else 0 for s in sets], dtype="uint64").view("int64")
            filled = [signature(s) for s in sets if len(s)]
            bands = band_hashes(np.array(filled)) if filled else np.zeros((0, BANDS), dtype="int64")
            offsets = np.concatenate([[0], np.cumsum((sizes > 0) * BANDS)]).astype("int32")
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands.ravel()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *map(pa.array, (sizes, sums, folds)), lists],
                ["doc_id", "n_shingles", "set_sum", "set_fold", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "t"):
            sets = list(_distinct_shingles(Words(part.column("t"))))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype("int32")
            values = np.concatenate(sets).view("int64") if sets else np.zeros(0, dtype="int64")
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["rep", "shingles"]
            )


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """``pairs`` (u, v) with ``linked``: the shingle sets of both overlap enough."""
    wanted = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    found = texts.join(wanted, "id", "left_semi")
    sets = materialize(map_batches(found, _sets, "rep long, shingles array<long>"), "sets")
    left = sets.select(F.col("rep").alias("u"), F.col("shingles").alias("a"))
    right = sets.select(F.col("rep").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b")).cast("long")
    union = F.size("a") + F.size("b") - both
    joined = pairs.join(left, "u").join(right, "v")
    return materialize(joined.select("u", "v", (100 * both >= percent * union).alias("linked")), "confirmed")


def _stars(rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Every member of a bucket with the bucket's smallest member, which is not listed itself."""
    centres = rows.groupBy(*keys).agg(F.min("rep").alias("centre"), F.max("rep").alias("last"))
    centres = materialize(centres.filter("centre != last").drop("last"), label)
    return rows.join(centres, keys).filter("rep != centre")


def _central_pairs(dealt: DataFrame, first: DataFrame) -> DataFrame:
    """New pairs of the members of each bucket with the one that shares most buckets with other documents.

    An original shares more buckets with its copies than they do with each other.
    """
    linked_to = first.filter("linked").groupBy(F.col("u").alias("rep")).agg(F.min("v").alias("linked_to"))
    sizes = dealt.groupBy("bucket").agg(F.count("*").alias("size"))
    shared = dealt.join(sizes, "bucket").groupBy("rep").agg(F.sum("size").alias("shared"))
    shared = shared.join(linked_to, "rep", "left").select("rep", F.coalesce("linked_to", "rep").alias("label"), "shared")
    weighed = materialize(dealt.join(shared, "rep"), "weighed")
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("shared", "rep", "label")).alias("centre"))
    apart = weighed.join(materialize(centres, "central"), "bucket").filter("label != centre.label AND rep != centre.rep")
    pairs = apart.select(F.greatest("rep", "centre.rep").alias("u"), F.least("rep", "centre.rep").alias("v")).distinct()
    return materialize(pairs.join(first, ["u", "v"], "left_anti"), "central-pairs")


def _open(dealt: DataFrame, labels: DataFrame) -> DataFrame:
    """(rep, label) of all members of buckets with members of different components."""
    named = dealt.join(labels, F.col("rep") == F.col("node"), "left")
    named = materialize(named.select("rep", "bucket", F.coalesce("component", "rep").alias("label")), "labelled")
    several = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    return materialize(named.join(several, "bucket", "left_semi").select("rep", "label").distinct(), "open")


def _rare_pairs(members: DataFrame, texts: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """All pairs of ``members`` (rep, label) of different labels whose sets can overlap enough, but for those compared.

    Shingles are ordered: first those of one label only, which no such pair shares, then from rare to frequent. ``rest``
    is how many of a set are left from a shingle on. The first shingle that a pair shares has all that it
    shares after it in both sets, so a pair that overlaps enough meets where ``rest`` allows for it.
    """
    found = texts.join(members.select(F.col("rep").alias("id")), "id", "left_semi")
    sets = map_batches(found, _sets, "rep long, shingles array<long>").join(members, "rep")
    shingles = sets.select("rep", "label", F.size("shingles").cast("long").alias("n"), F.xxhash64("shingles").alias("row"), F.explode("shingles").alias("shingle"))
    shingles = materialize(shingles, "open-shingles")
    counts = shingles.groupBy("shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("times"))
    counts = counts.filter("low != high").select("shingle", "times")
    ranked = (
        shingles.join(counts, "shingle").groupBy("rep", "label", "n", "row")
        .agg(F.sort_array(F.collect_list(F.struct("times", "shingle"))).alias("listed"))
        .filter(100 * F.size("listed") >= percent * F.col("n"))
        .select("rep", "label", "n", F.size("listed").cast("long").alias("m"), F.posexplode("listed"))
        .select("rep", "label", "n", "col.shingle", (F.col("m") - F.col("pos")).alias("rest"))
        .filter(100 * F.col("rest") >= percent * F.col("n"))
    )
    ranked = materialize(ranked, "rare-shingles")
    # Of two labels one at least is not the most frequent of the shingle.
    labels = ranked.groupBy("shingle", "label").agg(F.count("*").alias("times")).groupBy("shingle")
    main = labels.agg(F.max(F.struct("times", "label"))["label"].alias("main"), F.count("*").alias("labels")).filter("labels > 1")
    met = materialize(ranked.join(main, "shingle"), "met")
    a, b = met.filter("label != main").alias("a"), met.alias("b")
    close = F.least("a.rest", "b.rest") * (100 + percent) >= percent * (F.col("a.n") + F.col("b.n"))
    once = (F.col("b.label") == F.col("b.main")) | (F.col("a.label") < F.col("b.label"))
    pairs = a.join(b, (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.label") != F.col("b.label")) & once & close)
    pairs = pairs.select(F.greatest("a.rep", "b.rep").alias("u"), F.least("a.rep", "b.rep").alias("v")).distinct()
    return materialize(pairs.join(compared, ["u", "v"], "left_anti"), "rare-pairs")


def near_duplicates(
    docs: DataFrame, percent: int = 75, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """One row per document: id, size of its shingle set, ``component_id`` (smallest id it is linked with,
    directly or not; else its own) and ``kept`` (whether that is its own id).

    Documents are linked if their sets overlap by at least ``percent`` of their union. Null, empty and
    wordless texts have the empty set and no links. Rows with one id are one node: they share the
    smallest component that any of them reaches. A row without id is linked with nothing, has a null
    component and is kept. An empty table gives no rows; other columns are not read.
    """
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t"))
    sketches = materialize(
        map_batches(
            texts, _sketch, "doc_id long, n_shingles long, set_sum long, set_fold long, bands array<long>"
        ),
        "sketches",
    )
    key = ["n_shingles", "set_sum", "set_fold"]
    filled = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    reps = materialize(filled.groupBy(*key).agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "representatives")

    rows = reps.select("rep", F.posexplode("bands").alias("band", "value"))
    members = _stars(rows, ["band", "value"], "centres").select("band", "value", "rep", "centre")
    members = materialize(members, "members")
    pairs = members.select(F.col("rep").alias("u"), F.col("centre").alias("v")).distinct()
    first = _confirmed(pairs, texts, percent)

    failed = first.filter("NOT linked").select(F.col("u").alias("rep"), F.col("v").alias("centre"))
    mixed = members.join(failed, ["rep", "centre"], "left_semi").select("band", "value").distinct()
    in_mixed = members.join(mixed, ["band", "value"], "left_semi").select("rep", "centre", F.xxhash64("band", "value").alias("bucket"))
    dealt = in_mixed.select("rep", "bucket").union(in_mixed.select(F.col("centre").alias("rep"), "bucket").distinct())
    dealt = materialize(dealt, "dealt")
    second = _confirmed(_central_pairs(dealt, first), texts, percent)
    compared = first.union(second)
    links = compared.filter("linked").select("u", "v")
    labels = materialize(components(links, "stars"), "labels")
    third = _confirmed(_rare_pairs(_open(dealt, labels), texts, compared, percent), texts, percent)

    links = labels.select(F.col("node").alias("u"), F.col("component").alias("v")).union(third.filter("linked").select("u", "v"))
    placed = materialize(filled.join(reps.select(*key, "rep"), key).select("doc_id", "n_shingles", "rep"), "placed")
    repeated = placed.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).filter("low != high")
    rows_of_one_id = placed.join(repeated, "doc_id", "left_semi")
    links = links.union(rows_of_one_id.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")))
    found = components(links, "duplicates").withColumnRenamed("node", "rep")
    placed = placed.join(found, "rep", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")
    )
    rest = sketches.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    result = placed.union(rest)
    return result.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
