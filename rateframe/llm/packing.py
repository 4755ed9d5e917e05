"""Packing by concatenate and cut.

Documents are token sequences laid end to end in one global order: by the partition they were written
in, then by place in it. A first pass writes each document's tokens with the number of tokens before it
in its partition; totals per partition, summed up in order, then give every document its global offset. A
second pass cuts at fixed windows. A document that crosses a window edge becomes several pieces, marked
on both sides of the cut. Only the last sequence can be shorter than the window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateframe.llm.encoding import encoder
from rateframe.llm.textops import map_batches, text_slices
from rateframe.session import materialize

PIECE_BYTES = 8 << 20


def tokenized(docs: DataFrame, path: str, end_id: int, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """Tokens of every document (its ids, then ``end_id``) with its place: ``block`` and ``before``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = encoder(path)
        before = 0
        for batch in batches:
            for part in text_slices(batch, "t"):
                ids, offsets = units.encode(part.column("t"))
                n = np.diff(offsets) + 1
                ids = np.insert(ids, offsets[1:], end_id).astype("<u4")
                ends = np.concatenate([[0], np.cumsum(n)])
                blobs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(n), [None, pa.py_buffer(ends * 4), pa.py_buffer(ids.tobytes())]
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("block"), pa.array(before + ends[:-1]), pa.array(n), blobs.cast(pa.binary())],
                    ["doc_id", "block", "before", "n", "ids"],
                )
                before += int(ends[-1])

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"), F.spark_partition_id().alias("block"))
    return map_batches(rows, encode, f"doc_id {kind}, block int, before long, n long, ids binary")


def _cut(window: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "cut_before", "cut_after"]
        for batch in batches:
            for part in text_slices(batch, "ids", PIECE_BYTES):
                first = part.column("first").to_numpy()
                n = part.column("n").to_numpy()
                low = first // window
                pieces = (first + n - 1) // window - low + 1
                row = np.repeat(np.arange(len(n)), pieces)
                nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                sequence = low[row] + nth
                start = np.maximum(sequence * window - first[row], 0)
                stop = np.minimum((sequence + 1) * window - first[row], n[row])
                data = np.frombuffer(part.column("ids").buffers()[2], dtype="uint8")
                at = np.frombuffer(part.column("ids").buffers()[1], dtype="int32")[part.column("ids").offset :][: len(n)]
                a, b = at[row] + start * 4, at[row] + stop * 4
                blobs = pa.array([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], pa.binary())
                doc_id = part.column("doc_id").take(pa.array(row))
                columns = [start, stop - start, blobs, n[row], sequence, first[row] + start - sequence * window, start > 0, stop < n[row]]
                yield pa.RecordBatch.from_arrays([doc_id, *map(pa.array, columns)], names)

    return cut


def pack(
    docs: DataFrame, path: str, end_id: int, window: int, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """One row per piece: document, ``start`` and ``length`` in its tokens, the piece's ``ids`` (little-endian
    unsigned 32-bit), the document's tokens, the sequence and the ``offset`` there, and whether the
    document was cut before or after the piece.

    A null or empty text is its end token alone. Rows with null or repeated ids are documents of
    their own. An empty table gives no pieces. Other columns are not read.
    """
    written = materialize(tokenized(docs, path, end_id, text, id_column), "packing")
    totals = written.groupBy("block").agg(F.sum("n").alias("total"))
    earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    bases = totals.select("block", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    bases = materialize(bases, "packing-bases")  # so small a file that the join needs no shuffle of the tokens
    placed = written.join(bases, "block").select("doc_id", "n", "ids", (F.col("base") + F.col("before")).alias("first"))
    kind = written.schema["doc_id"].dataType.simpleString()
    return map_batches(
        placed,
        _cut(window),
        f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
        "cut_before boolean, cut_after boolean",
    )
