"""Exact distinct counts, sums and their merge over batches, for groups that are few and ids that are many.

An id is one bit of a bitmap of 32768 ids; a group has one bitmap per bucket of ids that it holds, whatever number of rows
they come from. Tasks build their bitmaps without a shuffle, and a union of bitmaps is the bitmap of the union. So the state of a batch
can be stored, merged with those of other batches, and counted at any time. For very many groups of few ids each, counting
folded rows takes less room.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 32768
HELD_BITMAPS = 8192
SUM_KIND = "sums"


def _build(ids: tuple[str, ...], sums: tuple[str, ...], bits: int, most: int, sum_kind: str) -> Callable:
    def build(batches):
        import numpy as np
        import pyarrow as pa

        names = ["part", "kind", "bucket", "bitmap", *sums]
        maps: dict[tuple, np.ndarray] = {}
        totals: dict = {}

        def flush():
            keys = list(maps)
            blobs = [np.packbits(maps[k], bitorder="little").tobytes() for k in keys]
            none = [pa.nulls(len(keys), pa.float64()) for _ in sums]
            if keys:
                parts = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string())]
                yield pa.RecordBatch.from_arrays([*parts, pa.array([k[2] for k in keys], pa.int64()), pa.array(blobs, pa.binary()), *none], names=names)
            if totals:
                keys = list(totals)
                parts = [pa.array(keys, pa.string()), pa.array([sum_kind] * len(keys), pa.string()), pa.array([0] * len(keys), pa.int64())]
                values = [pa.array([totals[k][i] for k in keys], pa.float64()) for i in range(len(sums))]
                yield pa.RecordBatch.from_arrays([*parts, pa.nulls(len(keys), pa.binary()), *values], names=names)
            maps.clear()
            totals.clear()

        for batch in batches:
            coded = batch["part"].dictionary_encode()
            labels = coded.dictionary.to_pylist()
            code = coded.indices.fill_null(len(labels)).to_numpy(zero_copy_only=False)
            labels.append(None)
            for kind in ids:
                known = batch[kind].is_valid().to_numpy(zero_copy_only=False)
                value = batch[kind].fill_null(0).to_numpy(zero_copy_only=False).astype("int64")[known]
                group, bucket, bit = code[known], value // bits, value % bits
                for b in np.unique(bucket).tolist():
                    inside = bucket == b
                    seen = np.zeros((len(labels), bits), dtype=bool)
                    seen[group[inside], bit[inside]] = True
                    for g in np.nonzero(seen.any(axis=1))[0].tolist():
                        key = (labels[g], kind, b)
                        maps[key] = maps[key] | seen[g] if key in maps else seen[g].copy()
            if sums:
                values = [batch[s].fill_null(0).to_numpy(zero_copy_only=False).astype("float64") for s in sums]
                added = np.stack([np.bincount(code, weights=v, minlength=len(labels)) for v in values], axis=1)
                for g in np.unique(code).tolist():
                    totals[labels[g]] = totals.get(labels[g], 0.0) + added[g]
            if len(maps) > most:
                yield from flush()
        yield from flush()

    return build


def distinct_state(rows: DataFrame, group: str, ids: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Mergeable state (part, kind, bucket, bitmap, sums) of whole-number ``ids`` and numbers ``sums`` per value of ``group``."""
    ids, sums = tuple(ids), tuple(sums)
    chosen = rows.select(F.col(group).cast("string").alias("part"), *[F.col(c).cast("bigint").alias(c) for c in ids], *[F.col(c).cast("double").alias(c) for c in sums])
    schema = ", ".join(["part string, kind string, bucket bigint, bitmap binary", *[f"{s} double" for s in sums]])
    return merge_states(chosen.mapInArrow(_build(ids, sums, BITS, HELD_BITMAPS, SUM_KIND), schema), sums=sums)


def merge_states(*states: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """The state of all rows that the given states are of."""
    both = states[0]
    for state in states[1:]:
        both = both.unionByName(state)
    return both.groupBy("part", "kind", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"), *[F.sum(s).alias(s) for s in sums])


def counts_of(state: DataFrame, ids: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """(part, one distinct count per id, sums) of a state."""
    bits = F.bitmap_count("bitmap")
    return state.groupBy("part").agg(
        *[F.coalesce(F.sum(F.when(F.col("kind") == c, bits)), F.lit(0)).cast("bigint").alias(c) for c in ids],
        *[F.coalesce(F.sum(s), F.lit(0.0)).alias(s) for s in sums],
    )
