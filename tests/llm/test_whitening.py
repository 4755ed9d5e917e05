import math
import random

import numpy as np
import pytest

from rateframe.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, d int, n long, x string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, 3, "own") for i, v in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.mark.parametrize("values", [
    [5.0, 3.0, 1.0], [1.0] * 4, [7.0, 1.0, 1.0, 1.0, 0.0], [0.0, 0.0], [2.0, -2.0, 0.0], [1e9, 1.0, 1e-3, 1e-9],
    list(range(1, 61)), [3.0] * 20 + [3.0 + 1e-13] * 20 + [100.0], [4.2],
])
def test_spectrum_of_known_matrices(values):
    draw = np.random.default_rng(len(values))
    axes, _ = np.linalg.qr(draw.standard_normal((len(values), len(values))))
    v = axes * np.array(values) @ axes.T
    v = (v + v.T) / 2
    found, vectors = whitening.spectrum(v)
    size = max(np.abs(values).max(), 1e-300)
    assert np.abs(found - np.sort(values)[::-1]).max() <= 1e-13 * size * len(values)
    assert np.abs(vectors.T @ vectors - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ vectors - vectors * found).max() <= 1e-12 * size


def test_spectrum_of_a_diagonal_with_shift_on_an_eigenvalue():
    found, vectors = whitening.spectrum(np.diag([1.0, 2.0, 3.0]))  # mean and median are eigenvalues
    assert np.allclose(found, [3, 2, 1], rtol=1e-14) and np.allclose(np.abs(vectors), np.eye(3)[:, ::-1], atol=1e-14)


def test_polar_factor_of_ill_conditioned_matrices():
    draw = np.random.default_rng(1)
    axes, _ = np.linalg.qr(draw.standard_normal((30, 30)))
    values = np.concatenate([np.logspace(0, -12, 15), -np.logspace(0, -12, 15)])
    u = whitening.polar_factor(axes * values @ axes.T)
    assert np.abs(u @ u - np.eye(30)).max() < 1e-12
    kept = np.abs(values) > 1e-6
    assert np.abs((axes.T @ u @ axes)[kept][:, kept] - np.diag(np.sign(values[kept]))).max() < 1e-8


def expected(rows, components=4):
    """(vec_id, component) -> n, deviation, whitened up to its sign, explained."""
    whole = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows if usable(v)]
    result = []
    for d in sorted({len(x) for _, x in whole}):
        different = sorted({x for _, x in whole if len(x) == d})
        n, sums = len(different), [sum(c) for c in zip(*different)]
        centred = np.array(different, dtype="float64") - np.array(sums) / n
        e, axes = np.linalg.eigh(centred.T @ centred / n)
        e, axes = e[::-1], axes[:, ::-1]
        for i, x in whole:
            if len(x) == d:
                deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums))
                for c in range(min(components, d)):
                    w = (np.array(x) - np.array(sums) / n) @ axes[:, c] / math.sqrt(e[c]) if e[c] > 1e-9 else 0.0
                    result.append((i, c + 1, n, deviation, abs(float(w)), float(e[c] / e.sum()) if e.sum() > 0 else 0.0))
    return result


def check(found, rows):
    wanted = sorted(expected(rows), key=str)
    got = [(r.vec_id, r.component, r.n, r.deviation, abs(r.whitened), r.explained) for r in found]
    assert len(got) == len(wanted)
    order = lambda r: (str(r[0]), r[1], r[2], r[3], round(r[4], 6))
    for a, b in zip(sorted(got, key=order), sorted(wanted, key=order)):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], abs=1e-8) and a[5] == pytest.approx(b[5], rel=1e-8, abs=1e-12)
    assert all(r.identity_error < 1e-9 for r in found)


def test_equals_numpy(spark):
    draw = random.Random(4)
    rows = [(i, [draw.gauss(0, 1 + k / 3) for k in range(7)]) for i in range(300)]
    rows += [(1000 + i, rows[5][1]) for i in range(200)] + [(3, rows[3][1])] * 2
    rows += [(2000, None), (2001, []), (2002, [1.0] * 6 + [None]), (2003, [float("nan")] * 7), (2004, [float("inf")] * 7), (None, [0.5] * 7)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_signs_agree_between_rows(spark):
    draw = random.Random(8)
    rows = [(i, [draw.gauss(0, 3), draw.gauss(0, 2), draw.gauss(0, 1)]) for i in range(100)]
    found = whitening.whiten(frame(spark, rows)).collect()
    x = np.array([[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows])
    w = np.zeros((100, 3))
    for r in found:
        w[r.vec_id, r.component - 1] = r.whitened
    assert np.allclose(w.T @ w / 100, np.eye(3), atol=1e-9)
    assert np.allclose(np.abs(np.corrcoef(w[:, 0], x[:, 0])[0, 1]), 1, atol=0.2)


def test_other_lengths_few_rows_and_no_variance(spark):
    rows = [(i, [i / 10, -i / 7]) for i in range(9)] + [(50 + i, [i * 0.5]) for i in range(4)] + [(70, [1.0, 2.0, 3.0])]
    rows += [(80 + i, [2.0, 2.0, 2.0, 2.0, 2.0]) for i in range(3)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)
    assert whitening.whiten(frame(spark, rows).limit(0)).count() == 0
    assert whitening.whiten(frame(spark, [(1, None)])).count() == 0
