"""Token ids of text columns for a word-based BPE vocabulary, in numpy.

The vocabulary drops white space and encodes runs of letters, single digits and runs of other
characters each by itself. Texts are cut into such units here, and each distinct unit is encoded by
the tokenizer once and remembered by its 64-bit hash. A white-space separated piece with anything
that could be read otherwise (an apostrophe, a bar, a control, letters beyond Latin) stays one unit, as it
stands, so that the tokenizer itself decides. The table of remembered units is bounded.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from rateframe.llm.textops import range_hashes, remembered, text_bytes

VOCABULARY = "word_bpe_49k.json"
REMEMBERED_UNITS = 1 << 20
REMEMBERED_BYTES = 64

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_KIND = np.full(256, _ODD, dtype="uint8")
_KIND[33:127] = _OTHER
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[[39, 124]] = _ODD  # apostrophe: contractions; bar: special tokens


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> UnitEncoder:
    """The encoder of this Python worker; what it remembers serves later tasks of the same map too."""
    return remembered(path, lambda: UnitEncoder(path))


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (simple pieces in lower case), text offsets, and begin and end of each unit."""
    raw, offsets = text_bytes(column)
    n = len(raw)
    if not n:
        none = np.zeros(0, dtype="int64")
        return raw, offsets, none, none
    kind = _KIND[raw]
    lead = np.nonzero((raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC5))[0]  # U+00C0 to U+017F, but no signs and no dotted I
    second = raw[lead + 1]
    lead = lead[((raw[lead] != 0xC3) | ((second != 0x97) & (second != 0xB7))) & ((raw[lead] != 0xC4) | (second != 0xB0))]
    kind[lead] = kind[lead + 1] = _LETTER
    begins = np.zeros(n + 1, dtype=bool)
    begins[offsets] = True
    inside = kind != _SPACE
    piece = begins[:n].copy()
    piece[1:] |= ~inside[:-1]
    piece &= inside
    first = np.nonzero(piece)[0]
    odd = kind == _ODD
    if odd.any() and len(first):
        whole = np.zeros(len(first), dtype=bool)
        whole[np.searchsorted(first, np.nonzero(odd)[0], side="right") - 1] = True
        simple = np.repeat(~whole, np.diff(np.append(first, n)))
        simple = np.concatenate([np.zeros(first[0], dtype=bool), simple])
    else:
        simple = np.ones(n, dtype=bool)
    change = kind == _DIGIT
    change[1:] |= kind[1:] != kind[:-1]
    opens = piece | (change & simple & inside)
    start = np.nonzero(opens)[0]
    closes = np.append(opens[1:] | ~inside[1:], True) | begins[1:]
    end = np.nonzero(closes & inside)[0] + 1
    raw = raw.copy()
    raw[simple & (raw >= 65) & (raw <= 90)] += 32
    return raw, offsets, start, end


class UnitEncoder:
    def __init__(self, path: str, remembered: int = REMEMBERED_UNITS):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.remembered = remembered
        self.known: dict[int, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offset at which each text begins."""
        offsets, distinct, which, ids = self._distinct(column)
        sizes = np.fromiter(map(len, distinct), dtype="int64", count=len(distinct)) // 4
        flat = np.frombuffer(b"".join(distinct), dtype="<u4")
        at = np.cumsum(sizes) - sizes
        length = sizes[which]
        ends = np.cumsum(length)
        source = np.repeat(at[which] - (ends - length), length) + np.arange(ends[-1] if len(ends) else 0)
        return flat[source], np.concatenate([[0], ends])[ids]

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of each text."""
        offsets, distinct, which, ids = self._distinct(column)
        sizes = np.fromiter(map(len, distinct), dtype="int64", count=len(distinct)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(sizes[which])])[ids])

    def unit_counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes and text offsets, end of each unit in bytes, and tokens from the first text to there."""
        raw, offsets, start, end = _units(column)
        distinct, which = self._encoded(raw, start, end)
        sizes = np.fromiter(map(len, distinct), dtype="int64", count=len(distinct)) // 4
        return raw, offsets, end, np.cumsum(sizes[which])

    def _distinct(self, column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
        raw, offsets, start, end = _units(column)
        distinct, which = self._encoded(raw, start, end)
        return offsets, distinct, which, np.searchsorted(start, offsets)

    def _encoded(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[list[bytes], np.ndarray]:
        hashes, example, which = np.unique(range_hashes(raw, start, end), return_index=True, return_inverse=True)
        keys = hashes.tolist()
        found = list(map(self.known.get, keys))
        missing = [i for i, b in enumerate(found) if b is None]
        if missing:
            if len(self.known) + len(missing) > self.remembered:
                self.known = {}
            words = [raw[start[example[i]] : end[example[i]]].tobytes() for i in missing]
            for i, word, ids in zip(missing, words, self._tokenized([w.decode("utf-8") for w in words])):
                found[i] = ids
                if len(word) <= REMEMBERED_BYTES:
                    self.known[keys[i]] = ids
        return found, which

    def _tokenized(self, words: list[str], together: int = 1024) -> list[bytes]:
        """Ids of each word. Words are encoded many at a time; the last token of each is a word end."""
        result = []
        for first in range(0, len(words), together):
            part = words[first : first + together]
            ids = np.asarray(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.nonzero(self.word_end[ids])[0] + 1
            if len(cuts) == len(part) and all(map(_is_simple, part)):
                ids = ids.tobytes()
                bounds = [0, *(cuts * 4).tolist()]
                result += [ids[a:b] for a, b in zip(bounds, bounds[1:])]
            elif together > 1:
                result += self._tokenized(part, max(1, together // 32))
            else:
                result += [ids.tobytes()]
        return result


def _is_simple(word: str) -> bool:
    """Read by the tokenizer as one unit: letters up to U+017F, one digit, or other ASCII characters."""
    return "'" not in word and "|" not in word and max(word) < "\u0180"
