import pickle
from collections import Counter

import pyarrow as pa

from rateframe.llm import decontamination as d
from tests.llm.helpers import prose, shingles, table, words
from tests.llm.test_minhash import changed


def brute_force(docs, items, threshold=0.75):
    found = {}
    for doc_id, text in docs:
        w = words(text)
        for item_id, item in items:
            own = words(item)
            width = min(len(own), len(w))
            if not width:
                continue
            weights, best = Counter(shingles(own)), 0
            for start in range(len(w) - width + 1):
                other = Counter(shingles(w[start : start + width]))
                best = max(best, sum((weights & other).values()) / sum((weights | other).values()))
            if best >= threshold:
                found[doc_id, item_id] = best
    return found


def test_matches_equal_brute_force(spark):
    items = [(k, prose(k, n)) for k, n in enumerate([16, 20, 33, 33, 47, 59, 3, 6])] + [(20, "a b " * 12)]
    docs = [(0, None), (1, ""), (2, "  "), (3, prose(77, 200))]
    for k, (_, item) in enumerate(items * 4):
        docs.append((10 + k, prose(500 + k, 40) + "\n" + changed(item.strip(), k // len(items), k).upper() + " " + prose(600 + k, 30)))
    docs += [(100, items[5][1]), (101, " ".join(items[5][1].split()[:50])), (102, "a b " * 40), (103, items[6][1])]
    items.append((None, prose(77, 30)))
    benchmark = spark.createDataFrame([*items, (30, None), (31, ""), (None, None), items[-1], items[0]], "item_id long, text string")
    for per_pass in (4, 1000):
        found = d.contaminated(table(spark, docs, extra=True), benchmark, items_per_pass=per_pass).collect()
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == {k: round(v, 9) for k, v in brute_force(docs, items).items()}
    assert {(r.doc_id, r.item_id) for r in found} >= {(3, None)}
    texts = dict(docs)
    for r in found:
        window = words(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert len(window) == r.n_words
    kept = d.without_contaminated(table(spark, docs, extra=True), benchmark, items_per_pass=4)
    assert {r.doc_id for r in kept.collect()} == set(texts) - {r.doc_id for r in found}
    assert kept.columns == table(spark, docs, extra=True).columns


def test_blocks_find_every_fingerprint_within_the_radius():
    import numpy as np

    items = [prose(k, 30) for k in range(12)]
    index = d.ItemIndex(list(range(12)), items)
    _, own, _ = index.groups[30]
    draw = np.random.default_rng(3)
    prints = np.repeat(own, 30, axis=0)
    for row in prints:
        for bit in draw.choice(128, draw.integers(0, 60), replace=False):
            row[bit // 8] ^= 1 << (bit % 8)
    window, item = index.near(30, prints)
    distance = d._DISTANCE[prints[:, None] ^ own[None]].sum(axis=2)
    assert set(zip(window.tolist(), item.tolist())) == {tuple(x) for x in np.argwhere(distance <= d.RADIUS).tolist()}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = table(spark, [(1, "a b c")])
    assert d.contaminated(docs, none).count() == 0
    assert d.contaminated(table(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0
    assert d.without_contaminated(docs, none).count() == 1


def test_an_index_is_small_whatever_the_lengths_of_its_items():
    """Each worker of the pipeline holds one: tables for every length took 25 KB an item."""
    texts = [prose(900 + n, n) for n in range(5, 65)]
    index = d.ItemIndex(list(range(len(texts))), texts)
    assert len(index.groups) == len(texts)
    assert len(pickle.dumps(index)) < 2000 * len(texts)
    for i, text in enumerate(texts):
        hashes = d.Words(pa.array([text])).hash
        assert (i, 0, i + 5, 1.0) in list(index.matches(hashes, 0.75))
