import math
import random

import numpy as np
import pytest

from rateframe.llm import pq_search

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, list int, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "own") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def brute_force(rows, least=0.9):
    """Sorted (vec_id, n_links, component_id, kept) rows."""
    n = [0] * len(rows)
    ids = {i for i, _ in rows if i is not None}
    component = {i: i for i in ids}
    at = [k for k, (i, v) in enumerate(rows) if i is not None and usable(v)]
    links = []
    for d in {len(rows[k][1]) for k in at}:
        of = [k for k in at if len(rows[k][1]) == d]
        x = np.array([rows[k][1] for k in of], dtype="float32").astype("float64")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        a, b = np.nonzero(x @ x.T >= least)
        for p, q in zip(a.tolist(), b.tolist()):
            if p < q:
                n[of[p]] += 1
                n[of[q]] += 1
                links.append((rows[of[p]][0], rows[of[q]][0]))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(component[a], component[b])
            changed |= component[a] != m or component[b] != m
            component[a] = component[b] = m
    return sorted(((i, n[k], component.get(i), i is None or component[i] == i) for k, (i, _) in enumerate(rows)), key=str)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in pq_search.near_duplicates(frame(spark, rows), **options).collect()), key=str)


def clusters(seed, sizes, d, noise, first=0):
    """Copies of random centres, each with noise of its own; cosines lie on both sides of 0.9."""
    draw = np.random.default_rng(seed)
    rows = []
    for size in sizes:
        centre = draw.standard_normal(d)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            step = draw.standard_normal(d)
            rows.append((centre + noise * draw.random() * step / np.linalg.norm(step)).astype("float32").tolist())
    order = draw.permutation(len(rows)).tolist()
    return [(first + i, rows[o]) for i, o in enumerate(order)]


@pytest.mark.parametrize("block", [4096, 50])
def test_equals_brute_force_when_no_border_is_left_out(spark, monkeypatch, block):
    monkeypatch.setattr(pq_search, "BLOCK_ROWS", block)
    rows = clusters(1, [1] * 250 + [2] * 60 + [9] * 10 + [180], 12, 0.45)
    draw = random.Random(2)
    hot = rows[0][1]
    rows += [(2000 + i, hot) for i in range(150)] + [(rows[3][0], rows[3][1])] * 2 + [(rows[9][0], rows[40][1])]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 12), (3003, [1.0] * 11 + [None]), (3004, [float("nan")] * 12), (3005, [float("inf")] * 12)]
    rows += [(None, hot), (None, None), (3006, [2 * x for x in hot]), (3007, [-x for x in hot]), (3008, [1e30] * 12), (3009, [1e-30] * 12)]
    rows += [(4000 + i, [draw.gauss(0, 1), draw.gauss(0, 1)]) for i in range(30)] + [(4100, [1.0]), (4101, [5.0]), (4102, [-1.0])]
    assert found(spark, rows, margin=1.0) == brute_force(rows)


@pytest.mark.parametrize("d,noise", [(8, 0.33), (24, 0.33), (64, 0.33), (100, 0.3)])
def test_recall_with_the_usual_margin(spark, d, noise):
    rows = clusters(d, [1] * 1500 + [3] * 300 + [40] * 5, d, noise)
    wanted, got = brute_force(rows), found(spark, rows)
    assert sum(r[1] for r in wanted) > 2000
    assert all(g[1] <= w[1] for g, w in zip(got, wanted))  # nothing below the limit
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in wanted)
    assert sum(g[2] == w[2] for g, w in zip(got, wanted)) >= 0.98 * len(wanted)


def test_codes_prune_and_lose_nothing():
    draw = np.random.default_rng(5)
    x = draw.standard_normal((3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[1500:] = x[:1500] + 0.05 * draw.standard_normal((1500, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = pq_search._fit(x, 20)
    home = pq_search._nearest(x, book.centroids)
    residual = x - book.centroids[home]
    codes = np.stack([pq_search._nearest(residual[:, p], w) for p, w in zip(book.parts, book.words)], axis=1)
    decoded = book.centroids[home].copy()
    for m, (p, w) in enumerate(zip(book.parts, book.words)):
        decoded[:, p] += w[codes[:, m]]
    error = np.linalg.norm(x - decoded, axis=1)
    radius = math.sqrt(0.2)
    members = np.nonzero(home == 3)[0]
    near = pq_search._candidates(x, book.centroids[3], book.stacked(), codes[members], ((radius + error[members]) ** 2 * (1 + 1e-5) + 1e-5).astype("float32"))
    linked = x @ x[members].T >= 0.9
    assert linked.sum() > len(members) and not (linked & ~near).any()
    assert near.mean() < 0.2


def test_few_and_no_vectors(spark):
    assert found(spark, [(5, [1.0, 0.0]), (3, [1.0, 0.1]), (9, [0.0, 1.0])]) == [(3, 1, 3, True), (5, 1, 3, False), (9, 0, 9, True)]
    assert found(spark, []) == []
    assert found(spark, [(1, None), (None, None)]) == [(1, 0, 1, True), (None, 0, None, True)]


def test_a_chain_is_one_component(spark):
    turns = [(i, [math.cos(i * 0.4), math.sin(i * 0.4)]) for i in range(8)]
    assert found(spark, turns) == [(i, 1 if i in (0, 7) else 2, 0, i == 0) for i in range(8)]
