"""Pages at any depth of a sorted table.

A limit of offset + size makes every task and then the driver keep all rows before the page. Here rows are sorted once by a
range shuffle and stored with their place. The counts of the ranges say which of them hold a page and where in it, so a
page reads only its own rows, and any page of the same order can follow.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rateframe.session import materialize

PART_BITS = 33


@dataclass(frozen=True)
class SortedRows:
    """Stored rows with ``_place`` (range, row in the range), and the rows of each range in order."""

    rows: DataFrame
    counts: list[tuple[int, int]]

    @property
    def total(self) -> int:
        return sum(n for _, n in self.counts)

    def slice(self, offset: int, size: int) -> DataFrame:
        """Rows ``offset`` to ``offset + size`` of the order, in order."""
        wanted, base = F.lit(False), 0
        for part, n in self.counts:
            first, last = max(offset - base, 0), min(offset + size - base, n)
            if first < last:
                low = part << PART_BITS
                wanted = wanted | F.col("_place").between(low + first, low + last - 1)
            base += n
        return self.rows.filter(wanted).orderBy("_place").drop("_place")


def sort_rows(df: DataFrame, *order: Column) -> SortedRows:
    """Rows in the given order. Rows that tie in all of it have some order that stays."""
    rows = materialize(df, "rows-to-sort")  # a range shuffle reads its input twice
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    stored = materialize(dealt.withColumn("_place", F.monotonically_increasing_id()), "sorted-rows")
    counts = stored.groupBy(F.shiftright("_place", PART_BITS).alias("part")).agg(F.count("*").alias("n")).orderBy("part")
    return SortedRows(stored, [(r.part, r.n) for r in counts.toLocalIterator()])


def page_of(df: DataFrame, order: Sequence[Column], offset: int, size: int, shallow: int) -> DataFrame:
    """One page: by a top list if it lies within the first ``shallow`` rows, else from the sorted table."""
    if offset + size <= shallow:
        return df.orderBy(*order).offset(offset).limit(size)
    return sort_rows(df, *order).slice(offset, size)
