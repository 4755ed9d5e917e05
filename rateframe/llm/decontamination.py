"""Benchmark decontamination by SimHash windows.

Every window of a document with as many words as a benchmark item has gets a 128-bit SimHash of its
5-word shingles, weighted by how often they occur in it. Fingerprints are cut into blocks. Two
fingerprints within the radius differ by at most radius / blocks bits in some block, so looking up each
block's value among all item blocks that close finds every item within the radius. Candidates are
confirmed by exact weighted similarity: the sum of the smaller weights over the sum of the larger ones.

Windows without any shingle of the benchmark have similarity 0 and get no fingerprint.

At a similarity of 0.75 two fingerprints differ in about 22 of 128 bits (standard deviation 4.3), so a
radius of 44 is five deviations away; shifted windows of the same passage are further chances.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.llm.textops import Words, map_batches, mix, shingle_hashes, text_slices

SHINGLE_WORDS = 5
RADIUS = 44
BLOCKS = 16
ITEMS_PER_PASS = 20_000
WINDOWS_AT_ONCE = 8192
_BITS = 128
_DISTANCE = np.array([bin(x).count("1") for x in range(256)], dtype="uint8")
_NEAR = _DISTANCE[np.arange(256)[:, None] ^ np.arange(256)[None]] <= RADIUS // BLOCKS


def _signs(hashes: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the bits of each shingle."""
    words = np.stack([mix(hashes), mix(~hashes)], axis=1)
    return np.unpackbits(words.view("uint8"), axis=1).astype("int32") * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    """Bytes (one per block) of weighted sums of signs."""
    return np.packbits(sums > 0, axis=1)


class ItemIndex:
    """Benchmark items of one pass: shingles, and fingerprints by length, a byte for each block.

    Every worker holds one, so nothing is kept per length and value of a block.
    """

    def __init__(self, item_ids: list[int | None], texts: list[str]):
        words = Words(pa.array(texts, pa.string()))
        self.item_id, self.shingles, self.weights = item_ids, [], []
        by_length: dict[int, list[int]] = {}
        for i, (first, last) in enumerate(zip(words.first, words.first[1:])):
            values, weight = np.unique(shingle_hashes(words.hash[first:last], SHINGLE_WORDS), return_counts=True)
            self.shingles.append(values)
            self.weights.append(weight)
            if last > first:
                by_length.setdefault(int(last - first), []).append(i)
        self.known = np.unique(np.concatenate([*self.shingles, np.zeros(0, dtype="uint64")]))
        holders: list[set[int]] = [set() for _ in self.known]
        for length, items in by_length.items():
            for i in items:
                for at in np.searchsorted(self.known, self.shingles[i]):
                    holders[at].add(length)
        self.lengths_of = [sorted(lengths) for lengths in holders]
        self.groups = {length: self._group(items) for length, items in by_length.items()}

    def _group(self, items: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        prints = np.stack(
            [_fingerprints((_signs(self.shingles[i]) * self.weights[i][:, None]).sum(axis=0)[None])[0] for i in items]
        )
        return np.array(items), prints, np.ascontiguousarray(prints.T)

    def near(self, length: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (window, item) within the radius, found by their blocks."""
        items, own, blocks = self.groups[length]
        hit = np.zeros((len(prints), len(items)), dtype=bool)
        for b in range(BLOCKS):
            values, which = np.unique(prints[:, b], return_inverse=True)
            hit |= _NEAR[values][:, blocks[b]][which]
        window, which = np.nonzero(hit)
        close = _DISTANCE[prints[window] ^ own[which]].sum(axis=1) <= RADIUS
        return window[close], items[which[close]]

    def similarity(self, item: int, shingles: np.ndarray) -> float:
        values, weight = np.unique(shingles, return_counts=True)
        _, a, b = np.intersect1d(self.shingles[item], values, assume_unique=True, return_indices=True)
        both = np.minimum(self.weights[item][a], weight[b]).sum()
        return both / (self.weights[item].sum() + weight.sum() - both)

    def matches(self, hashes: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window of each item that a text holds."""
        n = len(hashes)
        shingles = shingle_hashes(hashes, SHINGLE_WORDS)
        if not n or not len(self.known):
            return
        at = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        hits = np.nonzero(self.known[at] == shingles)[0]
        starts: dict[int, list[np.ndarray]] = {}
        for position in hits.tolist():
            for length in self.lengths_of[at[position]]:
                low = position - max(0, length - SHINGLE_WORDS)
                starts.setdefault(length, []).append(np.arange(low, position + 1))
        for length in self.groups:
            if length < min(n, SHINGLE_WORDS):  # the whole window is its only shingle
                runs = shingle_hashes(hashes, length)
                at = np.minimum(np.searchsorted(self.known, runs), len(self.known) - 1)
                if len(begin := np.nonzero(self.known[at] == runs)[0]):
                    starts.setdefault(length, []).append(begin)
        best: dict[int, tuple[float, int, int]] = {}
        for length, ranges in starts.items():
            width = min(length, n)
            inside = np.unique(np.clip(np.concatenate(ranges), 0, n - width))
            for first in range(0, len(inside), WINDOWS_AT_ONCE):
                begin = inside[first : first + WINDOWS_AT_ONCE]
                for item, start, score in self._matched(length, width, begin, hashes, shingles, threshold):
                    if (score, -start) > best.get(item, (0.0, 0, 0))[:2]:
                        best[item] = (score, -start, width)
        for item, (score, start, width) in sorted(best.items()):
            yield item, -start, width, score

    def _matched(self, length, width, begin, hashes, shingles, threshold) -> Iterator[tuple[int, int, float]]:
        run = max(1, width - SHINGLE_WORDS + 1)
        if width < min(len(hashes), SHINGLE_WORDS):
            rows = np.stack([shingle_hashes(hashes[b : b + width], SHINGLE_WORDS) for b in begin])
            sums = _signs(rows[:, 0])
        else:
            low, high = int(begin[0]), int(begin[-1]) + run
            if high - low > 4 * (run + len(begin)):  # far apart: in two halves
                half = len(begin) // 2
                yield from self._matched(length, width, begin[:half], hashes, shingles, threshold)
                yield from self._matched(length, width, begin[half:], hashes, shingles, threshold)
                return
            total = np.concatenate([np.zeros((1, _BITS), dtype="int32"), np.cumsum(_signs(shingles[low:high]), axis=0)])
            sums = total[begin - low + run] - total[begin - low]
        window, items = self.near(length, _fingerprints(sums))
        for w, item in zip(window.tolist(), items.tolist()):
            start = int(begin[w])
            score = self.similarity(item, shingle_hashes(hashes[start : start + width], SHINGLE_WORDS))
            if score >= threshold:
                yield item, start, float(score)


def _search(index: ItemIndex, threshold: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                words = Words(part.column("t"))
                rows, found = [], []
                for row, (first, last) in enumerate(zip(words.first, words.first[1:])):
                    for match in index.matches(words.hash[first:last], threshold):
                        rows.append(row)
                        found.append(match)
                item, start, width, score = zip(*found) if found else ((), (), (), ())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(rows, pa.int64())),
                        pa.array([index.item_id[i] for i in item], pa.int64()),
                        pa.array(start, pa.int64()),
                        pa.array(width, pa.int64()),
                        pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "item_id", "first_word", "n_words", "similarity"],
                )

    return search


def _item_passes(benchmark: DataFrame, items_per_pass: int) -> Iterator[ItemIndex]:
    """Indexes of the distinct items that have a text, a bounded number in each."""
    items = benchmark.filter("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").distinct()
    ids: list[int | None] = []
    texts: list[str] = []
    for item in items.orderBy("item_id", "text").toLocalIterator():
        if len(ids) == items_per_pass:
            yield ItemIndex(ids, texts)
            ids, texts = [], []
        ids.append(item.item_id)
        texts.append(item.text)
    if texts:
        yield ItemIndex(ids, texts)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = 0.75,
    text: str = "text",
    id_column: str = "doc_id",
    items_per_pass: int = ITEMS_PER_PASS,
) -> DataFrame:
    """One row per document row and benchmark item that it holds: the most similar window (the first of
    several) by its first word, its number of words, and the similarity, at least ``threshold``.

    An item of fewer than five words is one shingle; a text shorter than an item is one window. Null, empty
    and wordless texts or items match nothing. Items without id are searched like others, and each different
    text among them has rows of its own with a null item_id. Repeated rows match each by itself. A benchmark of any size is searched in passes of ``items_per_pass`` items.
    An empty table on either side gives no rows; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {kind}, item_id long, first_word long, n_words long, similarity double"
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    found = docs.sparkSession.createDataFrame([], schema)
    for index in _item_passes(benchmark, items_per_pass):
        found = found.union(map_batches(rows, _search(index, threshold), schema))
    return found


def without_contaminated(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, text: str = "text", items_per_pass: int = ITEMS_PER_PASS
) -> DataFrame:
    """The rows of ``docs``, with all their columns, that hold no benchmark item by the rules of
    ``contaminated``, each judged by its own text."""

    def keep(index: ItemIndex):
        def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in text_slices(batch, text):
                    words = Words(part.column(text))
                    kept = [next(index.matches(words.hash[a:b], threshold), None) is None for a, b in zip(words.first, words.first[1:])]
                    yield part.filter(pa.array(kept, pa.bool_()))

        return clean

    for index in _item_passes(benchmark, items_per_pass):
        docs = map_batches(docs, keep(index), docs.schema)
    return docs
