"""Token counts by prefix dynamic programming.

The count of a prefix that ends with a unit (a run of letters, a digit, a run of other characters) is the
count of the prefix before that unit plus the unit's own tokens, because tokens never cross units.
A text's counts at all these ends are stored once; truncation and budget questions are then searches
in two arrays, without encoding anything again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.llm.encoding import encoder
from rateframe.llm.textops import map_batches, text_slices


def count_tokens(
    docs: DataFrame, path: str, max_tokens: int, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """One row per document: bytes, tokens, and whether it has more than ``max_tokens``.

    The total is the last entry of the prefix counts. A null text counts as empty: no bytes, no tokens.
    Ids may be null or repeated; every row is counted by itself. An empty table gives an empty result;
    other columns are not read.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "t"):
                tokens = units.counts(part.column("t"))
                length = pc.fill_null(pc.binary_length(part.column("t")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), length, pa.array(tokens, pa.int64()), pa.array(tokens > max_tokens)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    return map_batches(rows, count, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def prefix_counts(docs: DataFrame, path: str, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: ``n_bytes``, its UTF-8 bytes; ``ends``, the code point at which each unit ends, and ``counts``, the exact
    number of tokens of the text up to there. The lists are empty for a null, empty or blank text. Ids may be
    null or repeated; an empty table gives an empty result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(path)
        for batch in batches:
            for part in text_slices(batch, "t"):
                raw, offsets, end, counts = units.unit_counts(part.column("t"))
                points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                cuts = np.searchsorted(end, offsets, side="right").astype("int32")
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(cuts))
                before = np.concatenate([[0], counts])[cuts[:-1]]
                arrays = (points[end] - points[offsets[row]], counts - before[row])
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(a, pa.int64())) for a in arrays]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(np.diff(offsets), pa.int64()), *lists], ["doc_id", "n_bytes", "ends", "counts"]
                )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    return map_batches(rows, count, f"doc_id {kind}, n_bytes long, ends array<long>, counts array<long>")


def total_tokens(counts: str = "counts") -> Column:
    """Tokens of the whole text: the last prefix count."""
    return F.coalesce(F.get(counts, F.size(counts) - 1), F.lit(0).cast("long"))


def longest_prefix(budget: int, ends: str = "ends", counts: str = "counts") -> Column:
    """Code points of the longest prefix, cut at the end of a unit, of at most ``budget`` tokens."""
    fitting = F.size(F.filter(counts, lambda c: c <= budget))
    return F.when(fitting > 0, F.element_at(ends, fitting)).otherwise(F.lit(0).cast("long"))


def tokens_until(position: int, ends: str = "ends", counts: str = "counts") -> Column:
    """Tokens of the units that end at or before a code point."""
    whole = F.size(F.filter(ends, lambda e: e <= position))
    return F.when(whole > 0, F.element_at(counts, whole)).otherwise(F.lit(0).cast("long"))
