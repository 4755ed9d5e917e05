"""Toxicity by a subsequence string kernel and a support vector machine.

The kernel of two strings sums, over all three-letter subsequences they share, the products of their
weights; a subsequence weighs DECAY to the power of the span it covers, so gaps and inserted letters cost
a little and not everything. Strings are units of a sentence: words without their punctuation, between
marks of begin and end, and runs of single letters joined into one. Values are divided by the norms.

Nyström landmarks (frequent insult candidates and clean units) turn the kernel into vectors, on which a
linear support vector machine with squared hinge loss is fitted. A sentence scores as its worst unit, a
document as its worst sentence. Labels are per document: at first the sentences of a toxic document that
hold a unit hardly seen in clean documents count as labelled; then the machine picks the
sentences itself, fits again, and adds the clean units it scored worst.

The fitted function is linear in subsequence weights, so it folds into one table of weight per
subsequence. That is exact, and it makes the cost of a unit independent of the number of landmarks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.llm.textops import Words, collect_bounded, map_batches, text_slices

DECAY = 0.6
LANDMARKS = 240
CLEAN_UNITS = 6000
ROUNDS = 3
ONE_SIDED = 12.0
RIDGE = 1e-2
STEEPNESS = 6.0
ABOVE_UNKNOWN = 0.25
FLOOR = 5.0  # how far below the threshold a text without any unit is
LONGEST_UNIT = 16
SAMPLED = {0: 2000, 1: 1000}  # labelled documents that a model is fitted on, at most
REMEMBERED_UNITS = 1 << 20
MATRIX_ROWS = 256  # a matrix has a column for each of up to 816 subsequences
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")
_DROPPED = re.compile(r"[\W_]+")
_TRIPLES = {
    n: (np.array(list(combinations(range(n), 3))).T, DECAY ** np.array([c - a + 1 for a, _, c in combinations(range(n), 3)]))
    for n in range(3, LONGEST_UNIT + 3)
}


# --- units ----------------------------------------------------------------------

def unit_of(word: str) -> str:
    return _DROPPED.sub("", word.lower())


def windows(unit: str) -> list[str]:
    """A unit with its marks; a long one in overlapping parts that cover all of it."""
    if len(unit) <= LONGEST_UNIT:
        return [f"^{unit}$"]
    step = LONGEST_UNIT // 2
    last = len(unit) - LONGEST_UNIT
    starts = [*range(0, last, step), last]
    return [("^" if s == 0 else "") + unit[s : s + LONGEST_UNIT] + ("$" if s == last else "") for s in starts]


def sentence_units(text: str) -> list[list[str]]:
    """Units of each sentence."""
    result = []
    for sentence in _SENTENCE.split(text):
        units, letters = [], []
        for word in [*sentence.split(), ""]:
            if len(word) == 1:
                letters.append(word)
            else:
                if len(letters) > 2:
                    units.append(unit_of("".join(letters)))
                letters = []
                units.append(unit_of(word))
        units = [u for u in units if u]
        if units:
            result.append(units)
    return result


def _matrices(strings: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and code points of strings of one length at a time, in parts of bounded size."""
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(strings):
        by_length.setdefault(len(s), []).append(i)
    for places in by_length.values():
        for first in range(0, len(places), MATRIX_ROWS):
            part = places[first : first + MATRIX_ROWS]
            joined = "".join(strings[i] for i in part).encode("utf-32-le", "surrogatepass")
            yield np.array(part), np.frombuffer(joined, dtype="<u4").reshape(len(part), -1)


def _norms(codes: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each string with itself."""
    count, n = codes.shape
    if n < 3:
        return np.ones(count)
    previous = np.ones((count, n + 1, n + 1))
    for order in range(3):
        last = order == 2
        total = np.zeros(count)
        current = np.zeros((count, n + 1, n + 1))
        for i in range(1, n + 1):
            running = np.zeros(count)
            for j in range(1, n + 1):
                same = codes[:, i - 1] == codes[:, j - 1]
                term = np.where(same, DECAY * DECAY * previous[:, i - 1, j - 1], 0.0)
                if last:
                    total += term
                else:
                    running = DECAY * running + term
                    current[:, i, j] = DECAY * current[:, i - 1, j] + running
        previous = current
    return np.sqrt(np.maximum(total, 1e-12))


# --- kernel ---------------------------------------------------------------------

class Alphabet:
    """Codes of the letters that landmarks use; 0 is any other letter."""

    def __init__(self, strings: list[str]):
        letters = sorted(set("".join(strings)))
        self.points = np.array([ord(c) for c in letters], dtype="uint32")
        self.size = len(letters) + 1

    def codes(self, points: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        return np.where(self.points[at] == points, at + 1, 0)

    def subsequences(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        (a, b, c), weight = _TRIPLES[points.shape[1]]
        codes = self.codes(points)
        known = (codes[:, a] > 0) & (codes[:, b] > 0) & (codes[:, c] > 0)
        return np.where(known, (codes[:, a] * self.size + codes[:, b]) * self.size + codes[:, c], 0), weight


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of strings (rows) and landmarks (columns)."""
    alphabet = Alphabet(landmarks)
    table: dict[int, int] = {}
    entries = []
    for place, points in _matrices(landmarks):
        if points.shape[1] < 3:
            continue
        index, weight = alphabet.subsequences(points)
        norm = _norms(points)
        for row, column in enumerate(place):
            for u, w in zip(index[row].tolist(), weight):
                entries.append((table.setdefault(u, len(table) + 1), column, w / norm[row]))
    vectors = np.zeros((len(table) + 1, len(landmarks)), dtype="float32")
    for row, column, value in entries:
        vectors[row, column] += value
    compact = np.zeros(alphabet.size**3, dtype="int32")
    compact[list(table)] = list(table.values())
    compact[0] = 0
    result = np.zeros((len(strings), len(landmarks)), dtype="float32")
    for place, points in _matrices(strings):
        if points.shape[1] < 3:
            continue
        index, weight = alphabet.subsequences(points)
        part = np.zeros((len(place), len(landmarks)), dtype="float32")
        for t in range(len(weight)):
            part += vectors[compact[index[:, t]]] * np.float32(weight[t])
        result[place] = part / _norms(points)[:, None]
    return result


def fit_squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> np.ndarray:
    """Weights (the last one for the constant) of a linear SVM with squared hinge loss, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype("float64")
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-8
    w = np.zeros(x.shape[1])
    before = None
    for _ in range(rounds):
        active = y * (x @ w) < 1
        if before is not None and np.array_equal(active, before):
            break
        before = active
        part = x[active] * weight[active][:, None]
        w = np.linalg.solve(part.T @ x[active] + np.diag(penalty), part.T @ y[active])
    return w


# --- model ----------------------------------------------------------------------

@dataclass
class Model:
    alphabet: Alphabet | None
    weights: np.ndarray
    constant: float
    threshold: float

    def units(self, units: list[str]) -> np.ndarray:
        """Decision value of each unit: that of its worst window."""
        parts = [windows(u) for u in units]
        flat = [w for ws in parts for w in ws]
        values = np.full(len(flat), self.constant)
        for place, points in _matrices(flat):
            if points.shape[1] >= 3:
                index, weight = self.alphabet.subsequences(points)
                values[place] += (self.weights[index] * weight).sum(axis=1) / _norms(points)
        first = np.cumsum([0, *map(len, parts)])[:-1]
        return np.maximum.reduceat(values, first) if len(units) else np.zeros(0)

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(STEEPNESS * (value - self.threshold), -60, 60)))


def _folded(landmarks: list[str], alpha: np.ndarray) -> tuple[Alphabet, np.ndarray]:
    """The sum of alpha times the kernel with each landmark, as one weight per subsequence."""
    alphabet = Alphabet(landmarks)
    weights = np.zeros(alphabet.size**3)
    for place, points in _matrices(landmarks):
        if points.shape[1] >= 3:
            index, weight = alphabet.subsequences(points)
            scaled = weight[None] * (alpha[place] / _norms(points))[:, None]
            np.add.at(weights, index.ravel(), scaled.ravel())
    weights[0] = 0
    return alphabet, weights


def _gapped(unit: str) -> list[str]:
    """The unit with a letter put in, at two places."""
    return [unit[:k] + "x" + unit[k:] for k in {max(1, len(unit) // 3), max(1, 2 * len(unit) // 3)}] if len(unit) > 3 else []


def fit(texts: list[str], labels: list[int]) -> Model:
    """A model from labelled documents, null texts being empty. Without both labels nothing is toxic."""
    texts, labels = zip(*dict.fromkeys(zip(texts, labels))) if texts else ((), ())
    bags = [sorted({u for s in sentence_units(t or "") for u in s}) for t in texts]
    toxic = [i for i, label in enumerate(labels) if label == 1 and bags[i]]
    clean = [i for i, label in enumerate(labels) if label == 0 and bags[i]]
    if not toxic or not clean:
        return Model(None, np.zeros(1), -1.0, 0.0)
    seen, among = Counter(u for i in toxic for u in bags[i]), Counter(u for i in clean for u in bags[i])

    often = max(3, len(toxic) // 125)
    one_sided = {u: (n + 0.05) / len(toxic) / ((among[u] + 0.5) / len(clean)) for u, n in seen.items()}
    apart = _without_copies([bags[i] for i in toxic])
    support = Counter(u for bag in apart for u in bag)
    sided = {u for u, n in support.items() if n >= often and one_sided[u] >= ONE_SIDED}
    telling = _explaining(apart, sided) | {u for u in sided if support[u] >= 2 * often}

    def witnesses(score: dict[str, float], least: float) -> list[str]:
        """Units for which a sentence counts as toxic: those of at least ``least``, or a document's worst one."""
        result = []
        for i in toxic:
            found = [u for u in bags[i] if u in telling or score[u] >= least]
            result += found or [max(bags[i], key=lambda u: (score[u], u))]
        return result

    worst = witnesses(one_sided, float("inf"))
    order = sorted(among, key=lambda u: (hash_order(u), u))
    negative = order[:CLEAN_UNITS]
    model = None
    for _ in range(ROUNDS):
        common = Counter(worst)
        positive = sorted(common, key=lambda u: (-common[u], u))
        chosen = [u for u in positive if among[u] * len(toxic) * 4 <= common[u] * len(clean)][: 2 * LANDMARKS // 3] or positive[:1]
        marks = [windows(u)[0] for u in dict.fromkeys([*chosen, *negative[-LANDMARKS // 6 :], *negative[: LANDMARKS // 6]])]
        values, vectors = np.linalg.eigh(kernel(marks, marks).astype("float64"))
        keep = values > 1e-6 * values[-1]
        whiten = vectors[:, keep] / np.sqrt(values[keep])
        bent = [g for u in chosen for g in _gapped(u)]
        examples = [*positive, *bent, *negative]
        x = kernel([windows(u)[0] for u in examples], marks) @ whiten
        y = np.array([1.0] * (len(positive) + len(bent)) + [-1.0] * len(negative))
        weight = np.array([float(min(common[u], 20)) for u in positive] + [2.0] * len(bent) + [1.0] * len(negative))
        w = fit_squared_hinge(x, y, weight)
        alphabet, weights = _folded(marks, whiten @ w[:-1])
        model = Model(alphabet, weights, float(w[-1]), 0.0)
        score = dict(zip(everything := sorted({*seen, *among}), model.units(everything).tolist()))
        worst = witnesses(score, 1.0)
        hard = sorted(among, key=lambda u: (-score[u], u))[: CLEAN_UNITS // 6]
        negative = list(dict.fromkeys([*negative, *hard]))
    top = lambda docs: np.array([max(score[u] for u in bags[i]) for i in docs])
    # A unit unlike all landmarks has the constant as its value, and is no insult.
    model.threshold = max(_split(top(clean), top(toxic)), model.constant + ABOVE_UNKNOWN)
    return model


def _without_copies(bags: list[list[str]]) -> list[list[str]]:
    """Bags of units that share less than half of their less common units with every bag kept before."""
    counts = Counter(u for bag in bags for u in bag)
    kept, holders = [], {}
    for bag in bags:
        rare = [u for u in bag if counts[u] <= 50]
        shared = Counter(k for u in rare for k in holders.get(u, ()))
        if shared and 2 * max(shared.values()) >= len(rare):
            continue
        for u in rare:
            holders.setdefault(u, []).append(len(kept))
        kept.append(bag)
    return kept


def _explaining(bags: list[list[str]], candidates: set[str]) -> set[str]:
    """Candidates picked greedily by the number of toxic documents that no earlier pick is in; at least two
    each. What stands beside an insult in copies of one document is never picked."""
    holders: dict[str, list[int]] = {}
    for i, bag in enumerate(bags):
        for u in candidates.intersection(bag):
            holders.setdefault(u, []).append(i)
    left = {u: len(docs) for u, docs in holders.items()}
    open_docs, picked = set(range(len(bags))), set()
    while left:
        best = max(left, key=lambda u: (left[u], len(holders[u]), u))
        if left[best] < 2:
            break
        picked.add(best)
        for i in holders[best]:
            if i in open_docs:
                open_docs.remove(i)
                for u in candidates.intersection(bags[i]):
                    left[u] -= 1
        del left[best]
        left = {u: n for u, n in left.items() if u not in picked}
    return picked


def hash_order(unit: str) -> int:
    import zlib

    return zlib.crc32(unit.encode("utf-8", "surrogatepass"))


def _split(low: np.ndarray, high: np.ndarray) -> float:
    """The middle of the widest gap between neighbouring values among those that err least."""
    values = np.unique(np.concatenate([low, high]))
    cuts = (values[1:] + values[:-1]) / 2 if len(values) > 1 else values
    low, high = np.sort(low), np.sort(high)
    errors = (len(low) - np.searchsorted(low, cuts)) / len(low) + np.searchsorted(high, cuts) / len(high)
    best = np.nonzero(errors <= errors.min() + 1e-12)[0]
    gaps = np.diff(values)[best] if len(values) > 1 else np.ones(1)
    return float(cuts[best[np.argmax(gaps)]])


# --- documents ------------------------------------------------------------------

class Scorer:
    """Probabilities of text columns. Values of words seen before are remembered, up to a bound: 16 bytes a word."""

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known, self.values = np.zeros(0, dtype="uint64"), np.zeros(0)  # by rising hash

    def __call__(self, column: pa.Array) -> np.ndarray:
        model, words = self.model, Words(column)
        hashes, example, which = np.unique(words.hash, return_index=True, return_inverse=True)
        new = ~np.isin(hashes, self.known, assume_unique=True)
        if len(self.known) + new.sum() > REMEMBERED_UNITS:
            self.forget()
            new[:] = True
        units = [unit_of(words.word(i)) for i in example[new]]
        values = np.full(len(units), model.threshold - FLOOR)
        filled = [i for i, u in enumerate(units) if u]
        if model.alphabet:
            values[filled] = model.units([units[i] for i in filled])
        known = np.concatenate([self.known, hashes[new]])
        order = np.argsort(known, kind="stable")
        self.known, self.values = known[order], np.concatenate([self.values, values])[order]
        worst = np.full(len(column), model.threshold - FLOOR)
        np.maximum.at(worst, words.row, self.values[np.searchsorted(self.known, hashes)][which])
        if model.alphabet:
            for row, unit in _spelled(words):
                worst[row] = max(worst[row], model.units([unit])[0])
        return model.probability(worst)


def _score(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in text_slices(batch, "t"):
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(scorer(part.column("t")))], ["doc_id", "score"])

    return score


def _spelled(words: Words) -> Iterator[tuple[int, str]]:
    """Row and letters of runs of more than two single letters."""
    lead = (words.raw[words.start] >= 0xC0).astype("int64") + (words.raw[words.start] >= 0xE0) + (words.raw[words.start] >= 0xF0)
    single = words.end - words.start == 1 + lead
    edges = np.nonzero(np.diff(np.concatenate([[0], single, [0]]).astype("int8")))[0]
    for first, last in zip(edges[::2].tolist(), edges[1::2].tolist()):
        while first < last:
            stop = min(last, int(words.first[words.row[first] + 1]))
            if stop - first > 2 and (unit := unit_of("".join(words.word(i) for i in range(first, stop)))):
                yield int(words.row[first]), unit
            first = stop


def labelled_sample(docs: DataFrame, labels: DataFrame, trainable, sampled: dict[int, int] = SAMPLED) -> DataFrame:
    """(doc_id, text, toxic) of at most ``sampled[label]`` documents of each label, chosen by a hash of the id."""
    ids = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(trainable("doc_id"))
    ids = ids.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label, limit in sampled.items():
        part = ids.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.union(part)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))  # of several texts under one id


def train(docs: DataFrame, labels: DataFrame, trainable, sampled: dict[int, int] = SAMPLED) -> Model:
    """A model from at most ``sampled[label]`` labelled documents of each label for which ``trainable(id)`` holds."""
    sample = labelled_sample(docs, labels, trainable, sampled)
    found = collect_bounded(sample, sum(sampled.values())).sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return fit(found.column("text").to_pylist(), found.column("toxic").to_pylist())


def toxicity(docs: DataFrame, model: Model, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id and ``score`` from 0 to 1; toxic at 0.5 or more.

    Null, empty and wordless texts score as the least toxic. Rows with null or repeated ids are scored each by
    itself. An empty table gives no rows; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    return map_batches(rows, _score(model), f"doc_id {kind}, score double")


def without_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below 0.5, each judged by its own text."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for part in text_slices(batch, text):
                yield part.filter(pa.array(scorer(part.column(text)) < 0.5))

    return map_batches(docs, keep, docs.schema)
