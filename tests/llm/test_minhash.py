import random

from rateframe.llm import minhash
from rateframe.llm.components import components
from tests.llm.helpers import prose, shingles, table, words


def brute_force(rows):
    sets = [(i, frozenset(shingles(words(t)))) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if i is None or j is None or not x or not y:
                continue
            if 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(i), root(j)))
                parent[high] = low
    return {i: root(i) for i in parent}


def check(spark, rows, **options):
    found = minhash.near_duplicates(table(spark, rows, **options)).collect()
    assert len(found) == len(rows)
    expected = brute_force(rows)
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.kept) == (expected[r.doc_id], expected[r.doc_id] == r.doc_id)
    return found


def changed(text, times, seed):
    draw, parts = random.Random(seed), text.split(" ")
    for _ in range(times):
        parts[draw.randrange(len(parts))] = f"new{draw.randrange(10**6)}"
    return " ".join(parts)


def test_components_equal_brute_force(spark):
    rows = [(i, prose(i, 60 + i)) for i in range(40)]
    for k in range(60):  # near copies on both sides of the threshold, and chains of them
        source = rows[random.Random(k).randrange(len(rows))][1]
        rows.append((100 + k, changed(source, k % 5, k)))
    rows += [(200 + k, prose(3, 63)) for k in range(10)]
    passage = prose(999, 50)
    rows += [(300 + k, passage + " " + prose(1000 + k, 12 + k % 20)) for k in range(60)]
    check(spark, rows, extra=True)


def test_copies_that_only_meet_in_their_original(spark):
    original = prose(5, 300, 10**6)
    rows = [(k, changed(original, 6, k)) for k in range(1000) if k != 500] + [(500, original)]
    sets = {i: frozenset(shingles(words(t))) for i, t in rows}
    assert all(100 * len(sets[500] & s) >= 75 * len(sets[500] | s) for s in sets.values())
    assert 100 * len(sets[0] & sets[1]) < 75 * len(sets[0] | sets[1])
    assert {r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()} == {0}


def test_rare_shingles_find_all_pairs(spark):
    passage = prose(1, 60)
    rows = [(k, f"{passage} {prose(100 + k, 10 + k % 40)}") for k in range(40)]
    rows += [(100 + k, changed(rows[k % 40][1], k % 4, k)) for k in range(120)]
    sets = {i: frozenset(shingles(words(t))) for i, t in rows}
    expected = {(i, j) for i in sets for j in sets if i > j and i % 7 != j % 7 and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    compared = {p for p in expected if sum(p) % 5 == 0}
    texts = table(spark, rows).toDF("id", "t")
    members = spark.createDataFrame([(i, i % 7) for i in sets], "rep long, label long")
    compared_rows = spark.createDataFrame([(*p, False) for p in sorted(compared)], "u long, v long, linked boolean")
    found = {(r.u, r.v) for r in minhash._rare_pairs(members, texts, compared_rows, 75).collect()}
    assert compared and expected - compared <= found and not found & compared
    assert all(i % 7 != j % 7 for i, j in found)


def test_nulls_empty_short_and_repeated_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, "one"), (7, prose(7, 90)),
            (7, prose(7, 90)), (8, prose(7, 90) + "  "), (9, "one two three four five six"), (9, prose(9, 80)), (10, prose(9, 80)),
            (11, "one two three four five six"), (12, "a " * 40_000), (13, "a a a a a")]
    found = check(spark, [r for r in rows if r[0] != 9])
    assert {r.doc_id: r.n_shingles for r in found}[1] == 0
    both = {r.doc_id: r.component_id for r in minhash.near_duplicates(table(spark, rows)).collect()}
    assert both[10] == both[11] == both[9] == 9  # one id with two texts joins the groups of both


def test_small_sets_still_meet():
    import numpy as np

    draw = np.random.default_rng(1)
    missed = 0
    for _ in range(200):
        shared = draw.integers(0, 2**64, 3, dtype="uint64")
        a, b = np.unique(shared), np.unique(np.append(shared, draw.integers(0, 2**64, dtype="uint64")))
        x, y = minhash.band_hashes(np.array([minhash.signature(a), minhash.signature(b)]))
        missed += not (x == y).any()
    assert missed <= 1  # similarity exactly 0.75


def test_empty_table(spark):
    assert minhash.near_duplicates(table(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert set(found) == {*range(41), *range(100, 160), 200, 201}
    assert all(c == (0 if n <= 40 else 100 if n < 200 else 200) for n, c in found.items())
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
