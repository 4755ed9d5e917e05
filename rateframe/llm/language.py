"""Language identification by hierarchical discrimination.

A text is the frequencies of its hashed byte n-grams, of letters and word gaps only. Linear support vector
machines first tell language families apart, one against the rest; then, within the family that wins,
one machine for each pair of its languages votes. Related languages so never compete with all others at once.

A machine's value is a sum over n-grams divided by their number, so whole texts of any length are read
once, without holding their features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rateframe.llm.textops import collect_bounded, map_batches, text_bytes, text_slices

BINS = 1 << 13
ORDERS = (1, 2, 3, 4)
SAMPLED_PER_LANGUAGE = 400  # labelled documents of each language that the machines are fitted on, at most
MOST_LANGUAGES = 400
RANKED_PARTS = 64
RIDGE = 1e-2
STEEPNESS = 3.0
UNDETERMINED = "und"

# Families of languages by code. Any other language is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk bg mk sr hr bs sl",
    "uralic": "fi et hu",
    "baltic": "lt lv",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi bn mr gu pa ur ne si",
    "semitic": "ar he am mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], dtype="uint32")
_GAP = np.arange(256, dtype="uint8")
_GAP[:65] = _GAP[91:97] = _GAP[123:128] = 32
_GAP[65:91] += 32


def family_of(language: str) -> str:
    return _FAMILY_OF.get(language.lower().split("-")[0], f"only {language}")


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with small letters and gaps, text offsets, and the bytes left in the text from each byte on."""
    raw, offsets = text_bytes(column)
    data = _GAP[raw]
    large = np.nonzero((raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97))[0] + 1
    data[large] += 32
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    return data, offsets, left


def _by_order(data: np.ndarray, offsets: np.ndarray, left: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per order: bins of the n-grams, and offsets of the texts in them. Runs of gaps say nothing."""
    n = len(data)
    wide = data.astype("uint32")
    gap = data == 32
    for order in ORDERS:
        if n < order:
            continue
        length = n - order + 1
        value = np.full(length, order, dtype="uint32")
        for k in range(order):
            value = (value ^ wide[k : k + length]) * _FACTORS[k]
            value ^= value >> np.uint32(15)
        keep = left[:length] >= order
        if order == 1:
            keep &= ~gap
        else:
            keep &= ~(gap[:length] & gap[1 : length + 1])
        places = np.nonzero(keep)[0]
        yield order, value[places] % np.uint32(BINS), np.searchsorted(places, offsets)


def features(texts: list[str]) -> np.ndarray:
    """Frequencies of n-grams of each text, by bin."""
    result = np.zeros((len(texts), BINS), dtype="float32")
    for row, text in enumerate(texts):
        data, offsets, left = _letters(pa.array([text], pa.string()))
        for _, bins, _ in _by_order(data, offsets, left):
            result[row] += np.bincount(bins, minlength=BINS)
        result[row] /= max(result[row].sum(), 1)
    return result


def fit_machine(gram: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 25) -> tuple[np.ndarray, float]:
    """Dual weights and constant of a squared-hinge SVM on a Gram matrix, by Newton steps. Both sides weigh alike."""
    n = len(y)
    weight = np.where(y > 0, n / max((y > 0).sum(), 1), n / max((y < 0).sum(), 1)) / 2
    active = np.ones(n, dtype=bool)
    beta, constant = np.zeros(n), 0.0
    for _ in range(rounds):
        index = np.nonzero(active)[0]
        size = len(index)
        system = np.zeros((size + 1, size + 1))
        system[:size, :size] = gram[np.ix_(index, index)] + np.diag(ridge * n / weight[index])
        system[:size, size] = system[size, :size] = 1
        solved = np.linalg.solve(system, np.append(y[index], 0))
        beta = np.zeros(n)
        beta[index], constant = solved[:-1], solved[-1]
        now = y * (gram @ beta + constant) < 1
        if np.array_equal(now, active) or not now.any():
            break
        active = now
    return beta, float(constant)


@dataclass
class Model:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    constants: np.ndarray

    def predict(self, values: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of machine values (families first, then pairs)."""
        many = len(self.families)
        p_family = 1 / (1 + np.exp(-np.clip(STEEPNESS * values[:, :many], -50, 50)))
        family = values[:, :many].argmax(axis=1)
        other = np.where(np.arange(many) == family[:, None], -np.inf, p_family).max(axis=1, initial=0.0)
        won = p_family[np.arange(len(family)), family]
        p_family = np.clip(won / (won + np.maximum(other, 0.0) + 1e-12), 0, 1)
        chosen, score = [], p_family.copy()
        members = [[i for i, code in enumerate(self.languages) if family_of(code) == f] for f in self.families]
        for row, f in enumerate(family.tolist()):
            own = members[f]
            votes = {i: 0.0 for i in own}
            least = {i: np.inf for i in own}
            for column, (a, b) in enumerate(self.pairs, many):
                if a in votes and b in votes:
                    v = values[row, column]
                    votes[a if v >= 0 else b] += 1 + np.tanh(abs(v)) / (len(own) ** 2)
                    least[a], least[b] = min(least[a], v), min(least[b], -v)
            best = max(own, key=lambda i: (votes[i], -i))
            chosen.append(self.languages[best])
            if len(own) > 1:
                score[row] *= 1 / (1 + np.exp(-np.clip(STEEPNESS * least[best], -50, 50)))
        return chosen, score


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Machines from labelled texts; None if there are none."""
    known = sorted(set(languages))
    if not known:
        return None
    x = features(texts)
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-6)
    x *= scale
    gram = (x @ x.T).astype("float64")
    label = np.array([known.index(code) for code in languages])
    families = sorted({family_of(code) for code in known})
    family = np.array([families.index(family_of(code)) for code in languages])
    pairs = [(a, b) for a, b in combinations(range(len(known)), 2) if family_of(known[a]) == family_of(known[b])]
    columns, constants = [], []
    for f in range(len(families)):
        if len(families) == 1:
            beta, constant = np.zeros(len(texts)), 1.0
        else:
            beta, constant = fit_machine(gram, np.where(family == f, 1.0, -1.0))
        columns.append(x.T @ beta * scale)
        constants.append(constant)
    for a, b in pairs:
        rows = np.nonzero((label == a) | (label == b))[0]
        beta, constant = fit_machine(gram[np.ix_(rows, rows)], np.where(label[rows] == a, 1.0, -1.0))
        columns.append(x[rows].T @ beta * scale)
        constants.append(constant)
    return Model(known, families, pairs, np.stack(columns, axis=1).astype("float32"), np.array(constants))


def _identify(model: Model | None):
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_slices(batch, "t"):
                texts = part.column("t")
                data, offsets, left = _letters(texts)
                lettered = np.diff(np.concatenate([[0], np.cumsum((data >= 97) & (data < 123))])[offsets]) > 0
                for row in np.nonzero(~lettered & (np.diff(offsets) > 0))[0].tolist():
                    lettered[row] = any(c.isalpha() for c in texts[row].as_py())
                language, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if model is not None:
                    sums = np.zeros((len(texts), model.weights.shape[1]))
                    total = np.zeros(len(texts))
                    for _, bins, ends in _by_order(data, offsets, left):
                        total += np.diff(ends)
                        for column in range(sums.shape[1]):
                            running = np.concatenate([[0.0], np.cumsum(model.weights[bins, column], dtype="float64")])
                            sums[:, column] += np.diff(running[ends])
                    language, score = model.predict(sums / np.maximum(total, 1)[:, None] + model.constants)
                pairs = [(code, float(s)) if has else (UNDETERMINED, 0.0) for code, s, has in zip(language, score, lettered)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.float64())],
                    ["doc_id", "lang_pred", "score"],
                )

    return identify


def train(docs: DataFrame, trainable, sampled: int = SAMPLED_PER_LANGUAGE) -> Model | None:
    """Machines from at most ``sampled`` documents of each language, chosen by a hash of the id, among rows
    with id, text and language for which the column ``trainable`` holds. Of several texts under one id the
    smallest counts.

    Ids alone are ranked, first within parts of a language, so no task gathers a language.
    """
    usable = docs.filter("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").filter(trainable)
    ids = usable.select("doc_id", "lang").distinct().withColumn("place", F.xxhash64("doc_id"))
    ids = ids.withColumn("part", F.pmod("place", F.lit(RANKED_PARTS)))
    for keys in (["lang", "part"], ["lang"]):
        order = Window.partitionBy(*keys).orderBy("place", "doc_id")
        ids = ids.withColumn("n", F.row_number().over(order))
        ids = ids.filter(F.col("n") <= sampled).drop("n")
    texts = usable.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    found = collect_bounded(texts, sampled * MOST_LANGUAGES).sort_by([("lang", "ascending"), ("doc_id", "ascending")])
    return fit(found.column("text").to_pylist(), found.column("lang").to_pylist())


def languages(docs: DataFrame, model: Model | None, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """One row per document: id, ``lang_pred`` and ``score`` from 0 to 1.

    Null and empty texts and those without a letter are ``und`` with score 0, and so is everything if no
    language was learned. Rows with null or repeated ids are handled each by itself. An empty table gives
    no rows; other columns are not read.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), F.col(text).alias("t"))
    return map_batches(rows, _identify(model), f"doc_id {kind}, lang_pred string, score double")
