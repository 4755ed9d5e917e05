"""Sharding by extendible hashing, in DataFrame functions only.

A directory is indexed by the first bits of a row's hash. A bucket that holds more bytes than the limit is split
on one more bit, and only such buckets are, until every bucket fits. Equivalently a row's bucket is the shortest
prefix of its hash whose bytes fit; so all depths can be judged at once on sums per prefix, a
few bits beyond the expected depth, and only buckets that still overflow need longer prefixes.

The hash of the key decides first. Rows of one key that overflow together are split on by a hash of the
whole row, in a directory below their bucket. Equal rows that overflow even so fill numbered pages, as
overflow pages of the bucket. So a key or a row with any share of the data makes shards within the limit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rateframe.llm.textops import own_names, unpacked
from rateframe.session import materialize

HASH_BITS = 60
MORE_BITS = 6
SLACK_BITS = 3
ADDED = ("bytes", "shard", "depth", "page")


def key_hash(columns: Sequence[Column]) -> Column:
    """60 bits of an MD5 over the columns as text; a null differs from an empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *parts)), 1, 15), 16, 10).cast("long")


def _prefix(value: Column, bits: Column) -> Column:
    return F.call_function("shiftright", value, F.lit(HASH_BITS) - bits)


def _leaves(rows: DataFrame, group: list[str], hashed: str, limit: int, bits: int) -> DataFrame:
    """``rows`` with ``depth``: length of the shortest prefix of their hash that fits, within each group, or
    that only one hash has."""
    done, rest, known = None, rows, -1
    while True:
        whole = F.lit(bits)
        cells = rest.groupBy(*group, _prefix(F.col(hashed), whole).alias("cell")).agg(
            F.sum("bytes").alias("bytes"), F.min(hashed).alias("low"), F.max(hashed).alias("high")
        )
        cells = materialize(cells, "cells")
        at = cells.select("*", F.explode(F.sequence(F.lit(known + 1), whole)).alias("depth"))
        at = at.withColumn("prefix", F.call_function("shiftright", F.col("cell"), whole - F.col("depth")))
        key = [*group, "depth", "prefix"]
        sums = at.groupBy(*key).agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))
        fitting = sums.filter((F.col("bytes") <= limit) | (F.col("low") == F.col("high"))).select(*key)
        leaves = at.select(*key, "cell").join(fitting, key).groupBy(*group, "cell").agg(F.min("depth").alias("depth"))
        leaves = materialize(cells.select(*group, "cell").join(leaves, [*group, "cell"], "left"), "leaves")
        placed = rest.withColumn("cell", _prefix(F.col(hashed), whole)).join(leaves, [*group, "cell"]).drop("cell")
        found = placed.filter("depth IS NOT NULL")
        done = found if done is None else done.unionByName(found)
        if leaves.filter("depth IS NULL").isEmpty():
            return done
        rest, known, bits = placed.filter("depth IS NULL").drop("depth"), bits, min(bits + MORE_BITS, HASH_BITS)


def _pages(rows: DataFrame, group: list[str], limit: int) -> DataFrame:
    """``rows``, equal within each group, with ``page``: as many on each page as fit, at least one.

    Numbers come from two passes, within written partitions and then over their counts, so that no group is
    gathered in one task.
    """
    rows = materialize(rows.withColumn("place", F.monotonically_increasing_id()), "equal-rows")
    rows = rows.withColumn("partition", F.shiftright("place", 33))
    counts = rows.groupBy(*group, "partition").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*group).orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*group, "partition", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    bases = materialize(bases, "equal-row-counts")
    within = Window.partitionBy(*group, "partition").orderBy("place")
    numbered = rows.withColumn("nth", F.row_number().over(within) - 1).join(bases, [*group, "partition"])
    fit = F.greatest(F.expr(f"{limit} div greatest(bytes, 1)"), F.lit(1))
    page = ((F.col("base") + F.col("nth")) / fit).cast("long")
    return numbered.withColumn("page", page).drop("place", "partition", "nth", "base")


def _bits(hashed: str, depth: str) -> Column:
    return F.expr(f"lpad(bin(shiftright({hashed}, {HASH_BITS} - {depth})), {depth}, '0')")


def shards(docs: DataFrame, key: Sequence[str], size: Column, limit: int) -> DataFrame:
    """``docs`` with ``bytes`` (a row's size), ``shard`` (bits of its bucket, and after a slash those of the
    bucket below it if one key overflowed), ``depth`` and ``page`` (0 unless equal rows overflowed).

    Rows of one (shard, page) have at most ``limit`` bytes together, except that a row larger than the limit
    has a page of its own. A null size counts as 0; null keys are one key. An empty table gives no rows.
    Columns of ``docs`` stay; one with the name of an added column is called ``own_`` and that name.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.coalesce(size.cast("long"), F.lit(0)).alias("bytes"),
        key_hash([F.col(c) for c in key]).alias("hash_key"),
        key_hash([F.col(c) for c in docs.columns]).alias("hash_row"),
    )
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    bits = min(HASH_BITS, max(1, (total // limit)).bit_length() + SLACK_BITS)
    placed = _leaves(rows, [], "hash_key", limit, bits)
    placed = placed.withColumn("bucket", _bits("hash_key", "depth"))
    # Only buckets of one key can still be over the limit.
    sums = placed.groupBy("bucket").agg(F.sum("bytes").alias("sum"))
    large = materialize(sums.filter(F.col("sum") > limit).select("bucket", "sum"), "large-buckets")
    columns = unpacked("row", own_names(docs.columns, ADDED))
    result = [*columns, "bytes", F.col("bucket").alias("shard"), "depth", F.lit(0).cast("long").alias("page")]
    if large.isEmpty():
        return placed.select(*result)
    fitting = placed.join(large, "bucket", "left_anti").select(*result)
    most = large.agg(F.max("sum")).first()[0]
    below = placed.join(large, "bucket").drop("depth", "sum")
    bits = min(HASH_BITS, max(1, (most // limit)).bit_length() + SLACK_BITS)
    below = _leaves(below, ["bucket", "hash_key"], "hash_row", limit, bits)
    below = below.withColumn("shard", F.concat("bucket", F.lit("/"), _bits("hash_row", "depth")))
    below = below.withColumn("depth", F.col("depth") + F.length("bucket"))
    sums = below.groupBy("shard").agg(F.sum("bytes").alias("sum"))
    equal = materialize(sums.filter(F.col("sum") > limit).select("shard"), "equal-buckets")
    single = below.join(equal, "shard", "left_anti").withColumn("page", F.lit(0).cast("long"))
    paged = _pages(below.join(equal, "shard", "left_semi"), ["shard"], limit)
    names = [*columns, *ADDED]
    return fitting.unionByName(single.select(*names)).unionByName(paged.select(*names))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per (shard, page) below ``path``."""
    sharded.repartition("shard", "page").write.partitionBy("shard", "page").parquet(path)
