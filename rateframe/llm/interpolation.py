"""Language-model scores by deleted interpolation.

The model mixes three estimates of a word after its predecessor: the bigram's relative frequency, the
word's, and a uniform one. How much each counts depends on how often the context was seen: contexts fall in
buckets by the power of two of their frequency. Expectation-maximisation learns each bucket's three
weights on deleted counts: every training token is predicted from the counts without itself. A context
that training never shows has no bigrams; its other two weights are those of all contexts together.

Every word is a context with counts of its own. Tasks hold the counts of the FREQUENT most frequent words, which
is a shortcut only: other counts are summed in parts, and scores do not depend on the bound.

Tokens travel as compact arrays to the part where their counts meet. Pairs of frequent words are dealt by pair,
a pair with one other word by that word. For a pair of two other words, the block of texts asks the part of each
word, and the answers meet in the block. A block asks once, too, for a pair that many of its texts share, so
no pair, however frequent, fills a part: it has less than HOT_TEXTS entries there from each block. Parts return sums per
text, not tokens.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rateframe.llm.textops import Words, collect_bounded, map_batches, mix, text_slices
from rateframe.session import materialize

FREQUENT = 1 << 17
HOT_TEXTS = 16
TOKENS_PER_PART = 2_000_000
HELD_WORDS = 1_000_000
CHUNK_BYTES = 8 << 20
BUCKETS = 34
STEPS_PER_OCTAVE = 4
EM_ROUNDS = 200
END = np.uint64(0x51ED270B27A3C9F5)
_LEVELS = 256
_PAIR = np.uint64(0x9FB21C651E98DF25)


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and ends, and the offset at which each text's tokens begin."""
    words = Words(column)
    sizes = np.diff(words.first) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    hashes = np.insert(words.hash, words.first[1:], END)
    return hashes, offsets


# --- word counts ----------------------------------------------------------------

def _merged(parts: list[list[np.ndarray]]) -> list[np.ndarray]:
    """One entry for each word of several lists of (words, trained, seen)."""
    words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    sums = [np.bincount(which, weights=np.concatenate([p[k] for p in parts]), minlength=len(words)) for k in (1, 2)]
    return [words, *(x.astype("int64") for x in sums)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []

    def counted() -> pa.RecordBatch:
        words, trained, seen = held[0]
        return pa.RecordBatch.from_arrays([pa.array(words.view("int64")), pa.array(trained), pa.array(seen)], ["word", "trained", "seen"])

    for batch in batches:
        for part in text_slices(batch, "t", CHUNK_BYTES):
            hashes, offsets = _tokens(part.column("t"))
            train = np.repeat(part.column("train").to_numpy(zero_copy_only=False), np.diff(offsets)).astype("int64")
            held = [_merged([*held, [hashes, train, np.ones(len(hashes), dtype="int64")]])]
            if len(held[0][0]) > HELD_WORDS:
                yield counted()
                held = []
    if held:
        yield counted()


@dataclass
class Dictionary:
    """The frequent words by sorted hash, how often each was trained on, and the totals of the corpus."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    vocabulary: int
    seen: int

    @property
    def rare(self) -> int:
        return len(self.words)

    @property
    def begin(self) -> int:
        return len(self.words) + 1

    def context_counts(self) -> np.ndarray:
        """Training frequency of each frequent word as a context, then a place for other words, and the begin."""
        end = self.counts[self.words == END].sum()
        return np.concatenate([np.where(self.words == END, 0, self.counts), [0, end]])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, self.rare)


def dictionary(rows: DataFrame, frequent: int) -> Dictionary | None:
    partial = map_batches(rows, _count_words, "word long, trained long, seen long")
    words = materialize(partial.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("seen").alias("seen")), "words")
    totals = words.agg(F.sum("trained"), F.sum((F.col("trained") > 0).cast("long")), F.sum("seen")).first()
    if totals[2] is None:
        return None
    end = F.col("word") != int(END.view("int64"))
    common = collect_bounded(words.orderBy(end, F.desc("seen"), "word").limit(frequent), frequent)
    hashes = common.column("word").to_numpy().view("uint64")
    order = np.argsort(hashes)
    counts = common.column("trained").to_numpy()[order]
    return Dictionary(hashes[order], counts, int(totals[0]), int(totals[1]), int(totals[2]))


# --- tokens dealt to parts --------------------------------------------------------

def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes by place value, compressed."""
    planes = b"".join(np.ascontiguousarray(a.view("uint8").reshape(len(a), -1).T).tobytes() for a in arrays)
    return zlib.compress(planes, 1)


def _unpack(blob: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    data, at, result = np.frombuffer(zlib.decompress(blob), dtype="uint8"), 0, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        plane = data[at : at + n * width].reshape(width, n)
        result.append(np.ascontiguousarray(plane.T).view(kind).reshape(n))
        at += n * width
    return result


def _rounded(values: np.ndarray) -> np.ndarray:
    """Doubles with 32 bits of their mantissa, the rest zero: an error below 2e-10 of each, and fewer bytes."""
    bits = values.astype("float64").view("int64")
    return ((bits + (1 << 19)) & ~((1 << 20) - 1)).view("float64")


def _deltas(sorted_keys: np.ndarray) -> np.ndarray:
    return np.diff(sorted_keys, prepend=np.uint64(0))


# Kinds of rows. A block's own rows pass through a part on their way back to the block.
TEXTS, SLOTS, USES = 0, 1, 2
COMMON, RARE_WORD, RARE_CONTEXT = 3, 4, 5
ASK_PAIR, ASK_WORD, ASK_CONTEXT = 6, 7, 8
PAIR_IS, WORD_IS, CONTEXT_IS = 9, 10, 11
SUMS, CELLS = 12, 13
ROWS = "block long, kind int, n long, blob binary"


def _rows(rows: list[tuple], names: list[str]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(names)
    types = {"kind": pa.int32(), "blob": pa.binary()}
    return pa.table({c: pa.array(values, types.get(c, pa.int64())) for c, values in zip(names, columns)})


def _read(table: pa.Table, kind: int, *fields: str, key: bool = True) -> list[np.ndarray]:
    """Block of each entry of one kind, then (as sums of their steps) the keys, then the other fields."""
    own = table.filter(pc.equal(table.column("kind"), kind))
    types = ("uint64", *fields) if key else fields
    sizes = own.column("n").to_numpy()
    found = [_unpack(blob.as_py(), n, *types) for blob, n in zip(own.column("blob"), sizes.tolist())]
    if key:
        found = [[np.cumsum(f[0]), *f[1:]] for f in found]
    columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0, dtype=t) for i, t in enumerate(types)]
    return [np.repeat(own.column("block").to_numpy(), sizes), *columns]


def _grouped(order_by: tuple[np.ndarray, ...], *values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Different keys in order, the group of each sorted entry, and values in that order."""
    order = np.lexsort(order_by[::-1])
    keys = [k[order] for k in order_by]
    first = np.ones(len(order), dtype=bool)
    if len(order):
        first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return [k[first] for k in keys], np.cumsum(first) - 1, [v[order] for v in values]


def _deal(words: Dictionary, parts: int, deleted: bool):
    """Rows (part, block, kind, n, blob): the texts of a block once, and its tokens by part.

    For ``deleted`` counts only training tokens are dealt, without telling texts apart.
    """

    def block_rows(block: int, part: pa.RecordBatch) -> Iterator[tuple]:
        width = np.uint64(words.begin + 1)
        hashes, offsets = _tokens(part.column("t"))
        sizes = np.diff(offsets)
        train = part.column("train").to_numpy(zero_copy_only=False)
        code = np.repeat((np.arange(len(sizes)) << 1 | train).astype("uint32"), sizes)
        ids = words.ids(hashes)
        context, before = np.empty(len(ids), dtype="int64"), np.zeros(len(ids), dtype="uint64")
        context[1:], before[1:] = ids[:-1], hashes[:-1]
        context[offsets[:-1]] = words.begin
        if deleted:
            chosen = (code & 1) == 1
            ids, context, hashes, before, code = ids[chosen], context[chosen], hashes[chosen], before[chosen], code[chosen] & 0 | 1
        else:
            doc_id = part.column("id")
            known = doc_id.is_valid().to_numpy(zero_copy_only=False)
            blob = _pack(doc_id.fill_null(0).to_numpy().astype("int64"), known.astype("uint8"), train.astype("uint8"), sizes.astype("int64"))
            yield block % parts, block, TEXTS, len(sizes), blob

        def dealt(kind: int, keys: np.ndarray, *fields: np.ndarray) -> Iterator[tuple]:
            for p, chosen in _by_part((mix(keys) % np.uint64(parts)).astype("int64")):
                yield p, block, kind, len(chosen), _pack(_deltas(keys[chosen]), *(f[chosen] for f in fields))

        frequent, seen_before = ids < words.rare, context != words.rare
        own = frequent & seen_before
        (keys, codes), group, _ = _grouped((ids[own].astype("uint64") * width + context[own].astype("uint64"), code[own]))
        times = np.bincount(group, minlength=len(keys)).astype("uint32")
        pairs, group, _ = _grouped((keys,))
        texts = np.bincount(group, minlength=len(pairs[0]))
        hot = texts >= HOT_TEXTS
        direct = ~hot[group]
        yield from dealt(COMMON, keys[direct], codes[direct], times[direct])
        trained = np.bincount(group, weights=(codes & 1) * times.astype("float64"), minlength=len(hot)).astype("uint32")
        hot_key, slots = pairs[0][hot], int(hot.sum())
        yield from dealt(ASK_PAIR, hot_key, np.arange(slots, dtype="uint32"), trained[hot])
        place = np.cumsum(hot) - 1
        uses = [(place[group[~direct]].astype("uint32"), codes[~direct], times[~direct])]

        for kind, own, key, other in (
            (RARE_WORD, ~frequent & seen_before, hashes, context),
            (RARE_CONTEXT, frequent & ~seen_before, before, ids),
        ):
            order = np.argsort(key[own], kind="stable")
            yield from dealt(kind, key[own][order], code[own][order], other[own][order].astype("uint32"))

        own = ~frequent & ~seen_before
        (word, follows), group, (codes,) = _grouped((hashes[own], before[own]), code[own])
        slot = np.arange(slots, slots + len(word), dtype="uint32")
        trained = np.bincount(group, weights=codes & 1, minlength=len(word)).astype("uint32")
        yield from dealt(ASK_WORD, word, slot, trained, follows)
        order = np.argsort(follows, kind="stable")
        yield from dealt(ASK_CONTEXT, follows[order], slot[order], trained[order])
        uses.append((slot[group], codes, np.ones(len(codes), dtype="uint32")))

        slot_of_use, codes, times = (np.concatenate(u) for u in zip(*uses))
        if len(slot_of_use):
            zeros = np.zeros(len(word), dtype="int64")
            known = words.context_counts()[(hot_key % width).astype("int64")], words.counts[(hot_key // width).astype("int64")]
            of_context, of_word = (np.concatenate([k.astype("int64"), zeros]) for k in known)
            yield block % parts, block, SLOTS, len(of_context), _pack(of_context, of_word)
            yield block % parts, block, USES, len(codes), _pack(slot_of_use, codes, times)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = 0
        for batch in batches:
            for part in text_slices(batch, "t", CHUNK_BYTES):
                rows = list(block_rows((int(part.column("pid")[0].as_py()) << 32) | chunk, part))
                chunk += 1
                yield from _rows(rows, ["part", "block", "kind", "n", "blob"]).to_batches()

    return deal


def _by_part(to: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(to, kind="stable")
    cuts = np.nonzero(np.diff(to[order], prepend=-1))[0]
    for first, last in zip(cuts, np.append(cuts[1:], len(order))):
        yield int(to[order[first]]), order[first:last]


@dataclass
class _Counted:
    """Tokens: block and text code of each, how many are alike, and training counts of context, pair and word."""

    block: np.ndarray
    code: np.ndarray
    times: np.ndarray
    context: np.ndarray
    pair: np.ndarray
    word: np.ndarray


def _totals(keys: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each entry the sum of the weights of its key."""
    _, which = np.unique(keys, return_inverse=True)
    return np.bincount(which, weights=weights, minlength=1)[which]


def _answers(kind: int, block: np.ndarray, slot: np.ndarray, count: np.ndarray) -> list[tuple]:
    return [(b, kind, len(at), _pack(slot[at], count[at].astype("int64"))) for b, at in _by_part(block)]


def _counted(table: pa.Table, words: Dictionary) -> Iterator[_Counted | list[tuple]]:
    """Counted tokens of one part, and rows for blocks: answers to what they asked, and their own rows."""
    width = np.uint64(words.begin + 1)
    context_counts = words.context_counts()

    block, key, code, times = _read(table, COMMON, "uint32", "uint32")
    to, asked, slot, trained = _read(table, ASK_PAIR, "uint32", "uint32")
    pair = _totals(np.concatenate([key, asked]), np.concatenate([(code & 1) * times.astype("float64"), trained]))
    context, word = (key % width).astype("int64"), (key // width).astype("int64")
    yield _Counted(block, code, times, context_counts[context], pair[: len(key)], words.counts[word])
    yield _answers(PAIR_IS, to, slot, pair[len(key) :])

    block, key, code, context = _read(table, RARE_WORD, "uint32", "uint32")
    to, asked, slot, trained, follows = _read(table, ASK_WORD, "uint32", "uint32", "uint64")
    train = (code & 1).astype("float64")
    word = _totals(np.concatenate([key, asked]), np.concatenate([train, trained]))
    pair = _totals(mix(key) ^ (context.astype("uint64") * _PAIR), train)
    yield _Counted(block, code, np.ones(len(key)), context_counts[context], pair, word[: len(key)])
    yield _answers(WORD_IS, to, slot, word[len(key) :])
    yield _answers(PAIR_IS, to, slot, _totals(mix(asked) ^ (follows * _PAIR), trained))

    block, key, code, word = _read(table, RARE_CONTEXT, "uint32", "uint32")
    to, asked, slot, trained = _read(table, ASK_CONTEXT, "uint32", "uint32")
    train = (code & 1).astype("float64")
    context = _totals(np.concatenate([key, asked]), np.concatenate([train, trained]))
    pair = _totals(mix(key) ^ (word.astype("uint64") * _PAIR), train)
    yield _Counted(block, code, np.ones(len(key)), context[: len(key)], pair, words.counts[word])
    yield _answers(CONTEXT_IS, to, slot, context[len(key) :])

    own = table.filter(pc.less_equal(table.column("kind"), USES)).select(["block", "kind", "n", "blob"])
    yield [tuple(r.values()) for r in own.to_pylist()]


def _answered(table: pa.Table) -> _Counted:
    """Tokens of a block whose counts it asked for."""
    _, of_context, of_word = _read(table, SLOTS, "int64", "int64", key=False)
    counts = {CONTEXT_IS: of_context, WORD_IS: of_word, PAIR_IS: np.zeros(len(of_context), dtype="int64")}
    for kind, known in counts.items():
        _, slot, count = _read(table, kind, "uint32", "int64", key=False)
        known[slot] = count
    block, slot, code, times = _read(table, USES, "uint32", "uint32", "uint32", key=False)
    return _Counted(block, code, times, counts[CONTEXT_IS][slot], counts[PAIR_IS][slot], counts[WORD_IS][slot])


def buckets(context_counts: np.ndarray) -> np.ndarray:
    """Bucket of each context: 0 if training never shows it, else one for each power of two of its frequency."""
    power = np.log2(np.maximum(context_counts, 1)).astype("int64")
    return np.where(context_counts > 0, np.minimum(power + 1, BUCKETS - 1), 0)


# --- mixture weights --------------------------------------------------------------

def _level(share: np.ndarray) -> np.ndarray:
    """0 for a share of 0, else its place on a logarithmic scale."""
    with np.errstate(divide="ignore"):
        level = np.floor(-STEPS_PER_OCTAVE * np.log2(share))
    return np.where(share > 0, np.clip(level, 0, _LEVELS - 2) + 1, 0).astype("int64")


def _cells(c: _Counted, tokens: int) -> tuple[np.ndarray, np.ndarray]:
    """Training tokens by bucket and deleted shares: cells, and of each the number and the sums of both shares."""
    before = c.context - 1
    pair = np.where(before > 0, (c.pair - 1) / np.maximum(before, 1), 0.0)
    word = (c.word - 1) / max(tokens - 1, 1)
    cell = (buckets(c.context) * _LEVELS + _level(pair)) * _LEVELS + _level(word)
    found, which = np.unique(cell, return_inverse=True)
    return found, np.stack([np.bincount(which, weights=w, minlength=len(found)) for w in (c.times, c.times * pair, c.times * word)])


def _part_cells(words: Dictionary):
    """Cells of a part's training tokens, and rows for blocks."""

    def cells(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for c in _counted(table, words):
            if isinstance(c, list):
                out += c
            elif len(c.block):
                found, sums = _cells(c, words.tokens)
                out.append((-1 - key[0].as_py(), CELLS, len(found), _pack(found, *sums)))
        return _rows(out, ["block", "kind", "n", "blob"])

    return cells


def _all_cells(tokens: int):
    """Cells that parts found, and those of tokens whose counts a block asked for."""

    def cells(key: tuple, table: pa.Table) -> pa.Table:
        _, *known = _read(table, CELLS, "int64", "float64", "float64", "float64", key=False)
        found, sums = _cells(_answered(table), tokens)
        columns = [np.concatenate(both) for both in zip(known, [found, *sums])]
        return pa.table(dict(zip(("cell", "n", "pair", "word"), columns)))

    return cells


def mixture_weights(cells: np.ndarray, n: np.ndarray, pair: np.ndarray, word: np.ndarray, uniform: float) -> np.ndarray:
    """Weights (bigram, word, uniform) of each bucket, by expectation-maximisation on cells of deleted counts.

    A bucket starts from, and is drawn a little towards, the weights of all buckets together. That of
    contexts never seen has those weights without the bigram's.
    """
    bucket = cells // (_LEVELS * _LEVELS)
    shares = np.stack([pair, word, np.full(len(n), uniform)], axis=1)

    def learn(chosen: np.ndarray, start: np.ndarray, imagined: float) -> np.ndarray:
        weights = start
        for _ in range(EM_ROUNDS):
            part = shares[chosen] * weights
            total = part.sum(axis=1, keepdims=True)
            expected = (n[chosen][:, None] * part / np.where(total > 0, total, 1)).sum(axis=0) + imagined * start
            weights = expected / expected.sum()
        return weights

    start = np.full(3, 1 / 3)
    together = learn(np.ones(len(n), dtype=bool), start, 1.0) if len(n) else start
    unseen = together * [0, 1, 1]
    return np.stack([unseen / unseen.sum(), *(learn(bucket == b, together, 10.0) for b in range(1, BUCKETS))])


# --- scores -----------------------------------------------------------------------

def _text_sums(c: _Counted, words: Dictionary, weights: np.ndarray) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """By block: its texts, and of each the log probability by the model and by the base, and known tokens."""
    mixed = weights[buckets(c.context)]
    pair = c.pair / np.maximum(c.context, 1)
    p = mixed[:, 0] * pair + mixed[:, 1] * c.word / max(words.tokens, 1) + mixed[:, 2] / (words.vocabulary + 1)
    base = np.log10((c.word + 1) / (words.tokens + words.vocabulary + 1))
    blocks, where = np.unique(c.block, return_inverse=True)
    texts, which = np.unique((where.astype("int64") << 32) | (c.code >> 1), return_inverse=True)
    sums = [np.bincount(which, weights=v * c.times, minlength=len(texts)) for v in (np.log10(p), base, (c.word > 0) * 1.0)]
    cuts = np.searchsorted(texts, np.arange(len(blocks) + 1) << 32)
    for block, first, last in zip(blocks.tolist(), cuts, cuts[1:]):
        yield block, texts[first:last] & 0xFFFFFFFF, [s[first:last] for s in sums]


def _part_scores(words: Dictionary, weights: np.ndarray):
    """Sums per text of a block, and rows for blocks."""

    def score(key: tuple, table: pa.Table) -> pa.Table:
        out = []
        for c in _counted(table, words):
            if isinstance(c, list):
                out += c
            else:
                for block, row, sums in _text_sums(c, words, weights):
                    out.append((block, SUMS, len(row), _pack(row.astype("uint32"), *map(_rounded, sums))))
        return _rows(out, ["block", "kind", "n", "blob"])

    return score


def _text_scores(words: Dictionary, weights: np.ndarray):
    def gather(key: tuple, table: pa.Table) -> pa.Table:
        info = table.filter(pc.equal(table.column("kind"), TEXTS))
        n = info.column("n")[0].as_py()
        doc_id, known, train, sizes = _unpack(info.column("blob")[0].as_py(), n, "int64", "uint8", "uint8", "int64")
        total = np.zeros((3, n))
        for _, row, sums in _text_sums(_answered(table), words, weights):
            total[:, row] += sums
        rest = table.filter(pc.equal(table.column("kind"), SUMS))
        entries = sorted(zip(rest.column("n").to_pylist(), rest.column("blob").to_pylist()))
        for size, blob in entries:
            row, *sums = _unpack(blob, size, "uint32", "float64", "float64", "float64")
            total[:, row] += sums
        return pa.table(
            {
                "doc_id": pa.array(doc_id, mask=known == 0),
                "trained_on": train == 1,
                "n_tokens": sizes,
                "n_known": np.rint(total[2]).astype("int64"),
                "train_tokens": np.full(n, words.tokens),
                "base_score": total[1],
                "score": total[0],
            }
        )

    return gather


def scores(docs: DataFrame, train, text: str = "text", id_column: str = "doc_id", frequent: int = FREQUENT) -> DataFrame:
    """One row per document: ``trained_on`` (whether the column ``train`` holds), tokens (words and one end),
    tokens known from training, training tokens of the corpus, ``base_score`` (add-one word
    frequencies) and ``score`` (the mixture), both log10 probabilities of the text.

    A null or empty text is an end alone. A null in ``train`` counts as false. Rows with null or repeated ids
    are texts of their own. An empty table gives no rows; other columns are not read. Words are
    told apart by 64-bit hashes. ``frequent`` bounds what tasks hold, not the result.
    """
    schema = "doc_id long, trained_on boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("t"), F.coalesce(train, F.lit(False)).alias("train"))
    words = dictionary(rows, frequent)
    if words is None:
        return docs.sparkSession.createDataFrame([], schema)
    parts = -(-words.seen // TOKENS_PER_PART)

    def dealt(deleted: bool) -> DataFrame:
        placed = rows.withColumn("pid", F.spark_partition_id())
        return map_batches(placed, _deal(words, parts, deleted), "part long, block long, kind int, n long, blob binary")

    cells = dealt(deleted=True).groupBy("part").applyInArrow(_part_cells(words), ROWS)
    cells = cells.groupBy("block").applyInArrow(_all_cells(words.tokens), "cell long, n double, pair double, word double")
    cells = cells.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("pair").alias("pair"), F.sum("word").alias("word"))
    found = collect_bounded(cells, BUCKETS * _LEVELS * _LEVELS).sort_by("cell")
    cell, n, pair, word = (found.column(c).to_numpy() for c in ("cell", "n", "pair", "word"))
    weights = mixture_weights(cell, n, pair / np.maximum(n, 1), word / np.maximum(n, 1), 1 / (words.vocabulary + 1))
    partial = dealt(deleted=False).groupBy("part").applyInArrow(_part_scores(words, weights), ROWS)
    return partial.groupBy("block").applyInArrow(_text_scores(words, weights), schema)
