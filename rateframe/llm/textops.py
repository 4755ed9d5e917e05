"""Words and word hashes of Arrow text columns, in numpy, and keys several operators share.

A word is a longest run of characters other than space and the controls 9 to 13. Letters A to Z
are lower-cased first. Hashes have 64 bits and are the same in every process and on every machine.
"""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SLICE_BYTES = 1 << 19  # hashing takes some 40 bytes for each of these
BATCH_ROWS = 1000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SHINGLE_FACTORS = 0xD6E8FEB86659FD93


def mix(values: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_BYTE_VALUES = mix(np.arange(1, 257, dtype="uint64"))
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` bytes of text each; a longer text is a part of its own."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0)
    part = np.cumsum(lengths.to_numpy(zero_copy_only=False).astype("int64")) // limit
    cuts = [0, *(np.nonzero(np.diff(part))[0] + 1).tolist(), batch.num_rows]
    for first, last in zip(cuts, cuts[1:]):
        yield batch.slice(first, last - first)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset at which each begins; null counts as empty."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype="int64")[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype="uint8") if data is not None else np.zeros(0, dtype="uint8")
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges; equal bytes have equal hashes wherever they stand."""
    n = len(raw)
    if not len(start):
        return np.zeros(0, dtype="uint64")
    powers = np.full(n, _MULTIPLIER, dtype="uint64")
    powers[0] = 1
    np.cumprod(powers, out=powers)
    sums = np.zeros(n + 1, dtype="uint64")
    np.cumsum(_BYTE_VALUES[raw] * powers, out=sums[1:])
    powers[:] = _INVERSE
    powers[0] = 1
    np.cumprod(powers, out=powers)
    return mix((sums[end] - sums[start]) * powers[start] ^ (end - start).astype("uint64"))


class Words:
    """Words of a text column: byte ranges, the row each is in, and their hashes."""

    def __init__(self, column: pa.Array):
        raw, self.offsets = text_bytes(column)
        self.raw = _LOWER[raw]
        n = len(self.raw)
        inside = ~_SPACE[self.raw]
        begins = np.zeros(n + 1, dtype=bool)
        begins[self.offsets] = True
        after = np.ones(n, dtype=bool)
        after[1:] = ~inside[:-1]
        self.start = np.nonzero(inside & (after | begins[:n]))[0]
        before = np.ones(n, dtype=bool)
        before[:-1] = ~inside[1:]
        self.end = np.nonzero(inside & (before | begins[1:]))[0] + 1
        self.row = np.searchsorted(self.offsets, self.start, side="right") - 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.hash = range_hashes(self.raw, self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> str:
        return self.raw[self.start[i] : self.end[i]].tobytes().decode("utf-8")


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words of one text; a shorter text is one run, none without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    total = np.full(n - width + 1, width, dtype="uint64")
    for k in range(width):
        factor = np.uint64((_SHINGLE_FACTORS * (2 * k + 3)) % (1 << 64) | 1)
        total += mix(words[k : n - width + 1 + k] ^ factor) * factor
    return mix(total)


_REMEMBERED: dict[str, object] = {}  # by this worker, for the tasks of one map


def remembered(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once in a worker and kept until a task of another map begins there."""
    if name not in _REMEMBERED:
        _REMEMBERED[name] = make()
    return _REMEMBERED[name]


def begin(this_map: str) -> None:
    """Drops what tasks of another map left behind in this worker."""
    if _REMEMBERED.get("this map") != this_map:
        _REMEMBERED.clear()
        give_back()
        _REMEMBERED["this map"] = this_map


def give_back() -> None:
    """Hands what a finished task has freed back to the system. Spark keeps Python workers for the stages that follow."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose workers find this package where the driver has it, if nothing installed it there.

    Whole texts travel at most BATCH_ROWS at a time: a batch is held on both sides, beside the heap, for every task that runs.
    """

    this_map = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(this_map)
        try:
            yield from function(batches)
        finally:
            give_back()

    if not 0 < int(df.sparkSession.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        df.sparkSession.conf.set(BATCH_CONF, str(BATCH_ROWS))
    paths = df.sparkSession.sparkContext.environment
    known = paths.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_HOME not in known:
        paths["PYTHONPATH"] = os.pathsep.join([p for p in known if p] + [PACKAGE_HOME])
    return df.mapInArrow(run, schema)


def remainder(doc_id: Column | str, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(column.cast("string").cast("binary")) % divisor).cast("int")


def own_names(columns: list[str], added: tuple[str, ...]) -> dict[str, str]:
    """The name under which each column stays beside ``added``: one that clashes gets ``own_`` in front, until it is free."""
    given, known = {c.lower() for c in columns}, {a.lower() for a in added}
    names = {}
    for column in columns:
        name = column
        while name.lower() in known or (name != column and name.lower() in given):
            name = f"own_{name}"
        names[column] = name
    return names


def unpacked(row: str, names: dict[str, str]) -> list[Column]:
    """The fields of a struct column as columns of these names."""
    return [F.col(row).getField(c).alias(name) for c, name in names.items()]


def empty_if_null(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def collect_bounded(df: DataFrame, limit: int) -> pa.Table:
    """All rows as an Arrow table, or an error if there are more than ``limit``."""
    found = df.limit(limit + 1).toArrow()
    if found.num_rows > limit:
        raise ValueError(f"more than {limit} rows")
    return found
