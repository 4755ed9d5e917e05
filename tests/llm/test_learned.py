import math
import random
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rateframe.llm import interpolation, language, queries, textops, toxicity
from rateframe.llm.textops import Words, remainder
from tests.llm.helpers import prose, table, words


# --- deleted interpolation ----------------------------------------------------------

def brute_force_scores(rows, trained_on):
    """(n_tokens, n_known, training tokens, base, score) by id, from plain counts of every word and pair."""
    tokens = {i: [*words(t), "\0"] for i, t in rows}
    train = [i for i in tokens if trained_on(i)]
    count = Counter(w for i in train for w in tokens[i])
    total, size = sum(count.values()), len(count)
    follow = {i: list(zip(["<begin>", *own[:-1]], own)) for i, own in tokens.items()}
    pairs, before = Counter(p for i in train for p in follow[i]), Counter(p[0] for i in train for p in follow[i])
    bucket = lambda h: int(math.log2(before[h])) + 1 if before[h] else 0
    cells = {}
    for i in train:
        for h, w in follow[i]:
            deleted = ((pairs[h, w] - 1) / (before[h] - 1) if before[h] > 1 else 0.0, (count[w] - 1) / (total - 1))
            level = interpolation._level(np.array(deleted))
            cell = (bucket(h) * 256 + int(level[0])) * 256 + int(level[1])
            n, a, b = cells.get(cell, (0, 0.0, 0.0))
            cells[cell] = (n + 1, a + deleted[0], b + deleted[1])
    cell = np.array(sorted(cells))
    n, a, b = np.array([cells[c] for c in cell]).T
    weights = interpolation.mixture_weights(cell, n, a / n, b / n, 1 / (size + 1))
    result = {}
    for i, own in tokens.items():
        score = 0.0
        for h, w in follow[i]:
            m = weights[bucket(h)]
            score += math.log10(m[0] * pairs[h, w] / max(before[h], 1) + m[1] * count[w] / total + m[2] / (size + 1))
        base = sum(math.log10((count[w] + 1) / (total + size + 1)) for w in own)
        result[i] = len(own), sum(count[w] > 0 for w in own), total, base, score
    return result


def test_scores_equal_brute_force_however_few_words_tasks_hold(spark, monkeypatch):
    monkeypatch.setattr(interpolation, "TOKENS_PER_PART", 700)
    monkeypatch.setattr(interpolation, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(interpolation, "HOT_TEXTS", 3)
    rows = [(i, f"w1 w2 w1 w2 {prose(i, 5 + i * 3 % 200, 60)}") for i in range(60)]
    rows += [(60 + i, f"{prose(i, 40, 900)} {prose(i % 7, 20, 9000)}") for i in range(40)]
    rows += [(100, None), (101, ""), (102, "Unseen WORDS only"), (103, "w1 " * 3000)]
    docs = table(spark, rows, extra=True)
    expected = brute_force_scores(rows, lambda i: i % 3)
    for frequent in (5000, 12, 1):
        found = {r.doc_id: r for r in interpolation.scores(docs, F.col("doc_id") % 3 != 0, frequent=frequent).collect()}
        assert found.keys() == expected.keys()
        for i, (n_tokens, n_known, total, base, score) in expected.items():
            r = found[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n_tokens, n_known, total), (frequent, i)
            assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6), (frequent, i)


def test_query_equals_brute_force(spark, data):
    rows = [(r.doc_id, r.text, r.held) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held")).collect()]
    held = {i for i, _, h in rows if h}
    expected = brute_force_scores([(i, t) for i, t, _ in rows], lambda i: i not in held)
    found = {r.doc_id: r for r in queries.op4_deleted_interpolation(spark, data).collect()}
    assert found.keys() == expected.keys()
    for i, (n_tokens, n_known, total, base, score) in expected.items():
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i in held, n_tokens, n_known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)


def test_a_pair_of_all_texts_has_few_entries_in_its_part(monkeypatch):
    monkeypatch.setattr(interpolation, "HOT_TEXTS", 4)
    batch = pa.RecordBatch.from_pydict({"t": ["of the of the"] * 900 + ["of the"], "id": list(range(901)), "train": [True] * 901, "pid": [0] * 901})
    hashes = np.sort(np.append(Words(pa.array(["of the"])).hash, interpolation.END))
    held = interpolation.Dictionary(hashes, np.array([1801, 1801, 901]), 5000, 3, 5000)
    dealt = pa.Table.from_batches(interpolation._deal(held, 1, deleted=False)([batch])).to_pylist()
    entries = {r["kind"]: r["n"] for r in dealt}
    assert entries[interpolation.ASK_PAIR] == 4 and interpolation.COMMON not in entries


def test_probabilities_of_all_words_sum_to_one():
    weights = interpolation.mixture_weights(np.array([5 * 65536 + 3 * 256 + 2]), np.array([10.0]), np.array([0.2]), np.array([0.1]), 0.01)
    assert np.allclose(weights.sum(axis=1), 1) and (weights >= 0).all() and weights[0][0] == 0


def test_scores_of_rows_without_id_and_empty_table(spark):
    docs = table(spark, [(None, "a b"), (None, "a b"), (1, "a b"), (1, "a c")])
    found = interpolation.scores(docs, F.col("doc_id") == 1).collect()
    assert sorted(str(r.doc_id) for r in found) == ["1", "1", "None", "None"] and all(r.train_tokens == 6 for r in found)
    assert interpolation.scores(table(spark, []), F.lit(True)).count() == 0
    nothing = interpolation.scores(table(spark, [(1, "a")]), F.lit(False)).collect()
    assert nothing[0].train_tokens == 0 and math.isfinite(nothing[0].score)


# --- toxicity -------------------------------------------------------------------

def kernel_by_definition(a, b):
    weights = []
    for s in (a, b):
        total = Counter()
        for places in combinations(range(len(s)), 3):
            total["".join(s[p] for p in places)] += toxicity.DECAY ** (places[2] - places[0] + 1)
        weights.append(total)
    product = lambda x, y: sum(v * y[u] for u, v in x.items())
    return product(weights[0], weights[1]) / math.sqrt(product(weights[0], weights[0]) * product(weights[1], weights[1]))


def test_kernel_equals_its_definition():
    strings, marks = ["^idiot$", "^idxiot$", "^banana$", "^été$", "^zz$"], ["^idiot$", "^aaaa$", "^stupid$"]
    found = toxicity.kernel(strings, marks)
    for i, s in enumerate(strings):
        for j, m in enumerate(marks):
            assert abs(found[i, j] - kernel_by_definition(s, m)) < 1e-5


def corpus(n=400):
    draw, texts, labels = random.Random(8), [], []
    for i in range(n):
        parts = prose(i, draw.randrange(20, 80), 500).replace("w", "word").split(" ")
        toxic = draw.random() < 0.4
        for _ in range(toxic * draw.randrange(1, 3)):
            parts.insert(draw.randrange(len(parts)), draw.choice(["grumbler", "snortling", "blockhead"]))
        texts.append(" ".join(parts) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_model_finds_plain_gapped_and_spelled_insults(spark):
    texts, labels = corpus()
    model = toxicity.fit(texts[:300], labels[:300])
    probes = ["you GRUMBLER!", "what a grumxbler", "s n o r t l i n g", "b_l_o_c_k_head", "word44 word7 word12", "", None, "!!", "w " * 9]
    docs = table(spark, [*enumerate(texts[300:]), *((1000 + i, t) for i, t in enumerate(probes))], extra=True)
    found = {r.doc_id: r.score for r in toxicity.toxicity(docs, model).collect()}
    assert np.mean([(found[i] >= 0.5) == bool(label) for i, label in enumerate(labels[300:])]) >= 0.97
    assert [found[1000 + i] >= 0.5 for i in range(len(probes))] == [True] * 4 + [False] * 5
    assert all(0 <= s <= 1 for s in found.values())
    kept = toxicity.without_toxic(docs, model)
    assert {r.doc_id for r in kept.collect()} == {i for i, s in found.items() if s < 0.5} and kept.columns == docs.columns


def test_toxicity_without_labels_and_rows(spark):
    model = toxicity.fit([], [])
    assert [r.score < 0.5 for r in toxicity.toxicity(table(spark, [(None, "any"), (None, "any")]), model).collect()] == [True, True]
    assert toxicity.toxicity(table(spark, []), model).count() == 0
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.train(table(spark, [(1, "a")]), labels, lambda c: F.lit(True)).alphabet is None


# --- language ---------------------------------------------------------------------

def test_held_out_accuracy_and_undetermined_texts(spark, data):
    rows = queries.op8_hierarchical_language(spark, data)
    known = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    right = rows.filter("held_out").join(known, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.9
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = language.train(docs, remainder("doc_id", 4) != 2)
    odd = [(1, None), (2, ""), (3, "123 !! 45"), (None, "the of and to"), (5, "日本"), (6, "the " * 50_000)]
    found = [(r.doc_id, r.lang_pred, r.score) for r in language.languages(table(spark, odd, extra=True), model).collect()]
    assert [f[1] == "und" for f in found] == [True, True, True, False, False, False] and all(0 <= f[2] <= 1 for f in found)


def test_language_of_nothing_learned(spark):
    assert language.fit([], []) is None
    assert language.languages(table(spark, [(1, "abc")]), None).first().lang_pred == "und"
    assert language.languages(table(spark, []), None).count() == 0
    one = language.fit(["abc def", "abc"], ["en", "en"])
    assert language.languages(table(spark, [(1, "abc")]), one).first().lang_pred == "en"


def test_remembered_words_take_16_bytes_each_and_change_no_score(monkeypatch):
    texts = [prose(i, 300, 3000) + (" zorgblat" if i % 4 == 0 else "") for i in range(80)]
    model = toxicity.fit(texts, [int(i % 4 == 0) for i in range(80)])
    column = pa.array([*texts, None, "", "... !"])
    whole = toxicity.Scorer(model)
    expected = whole(column)
    assert np.array_equal(whole(column), expected)
    assert len(whole.known) > 2000
    assert whole.known.nbytes + whole.values.nbytes == 16 * len(whole.known)
    monkeypatch.setattr(toxicity, "REMEMBERED_UNITS", 500)
    small = toxicity.Scorer(model)
    parts = [small(column.slice(i, 7)) for i in range(0, len(column), 7)]
    assert np.array_equal(np.concatenate(parts), expected)


def test_texts_travel_in_batches_of_bounded_rows(spark):
    spark.conf.set(textops.BATCH_CONF, "10000")
    rows = spark.range(3000).coalesce(1).selectExpr("id as doc_id", "'a b' as text")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    assert max(r.n for r in textops.map_batches(rows, sizes, "n long").collect()) <= textops.BATCH_ROWS
