"""Whitening against numpy's own eigenvectors and exact integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from meterwright.llm import whitening

VECTORS = "vec_id long, embedding array<float>, label int, x string, dim string, component int"


def table(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v], 1, "x", "y", 2) for k, v in vectors], VECTORS)


def check(rows, vectors, k=4):
    """All columns but the sign of a component against plain arithmetic; vectors of one length."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in vectors if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, d = len(fit), len(fit[0])
    total = [sum(x[j] for x in fit) for j in range(d)]
    y = np.array([[float(Fraction(n * x[j] - total[j], n)) for j in range(d)] for x in fit])
    cov = y.T @ y / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    k = min(k, d)
    assert len(rows) == k * len(kept)
    got = {}
    for r in rows:
        got.setdefault((r.vec_id, r.component), []).append(r)
    real = values[:k] > 1e-10 * max(values[0], 1e-300)
    signs = {}
    for i, x in kept:
        whole = sum((n * x[j] - total[j]) ** 2 for j in range(d))
        centre = np.array([float(Fraction(n * x[j] - total[j], n)) for j in range(d)])
        for c in range(k):
            r = got[(i, c + 1)][0]
            assert r.n == n and r.deviation == (whole if whole < 2**63 else None)
            assert r.identity_error <= 1e-9
            if not real[c]:
                assert r.whitened is None and r.explained == 0
                continue
            assert r.explained == pytest.approx(values[c] / np.trace(cov), rel=1e-8)
            want = centre @ vecs[:, c] / math.sqrt(values[c])
            if abs(want) > 1e-3:
                signs.setdefault(c, []).append(np.sign(want) * np.sign(r.whitened))
            assert abs(r.whitened) == pytest.approx(abs(want), rel=1e-6, abs=1e-6)
    assert all(len(set(s)) == 1 for s in signs.values())


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.1, 12) + 5
    vectors = [(k, v.tolist()) for k, v in enumerate(base)]
    vectors += [(400 + k, base[k].tolist()) for k in range(40)] + [(7, base[7].tolist()), (None, base[8].tolist())]
    vectors += [(500, None), (501, [1.0] * 11 + [None]), (502, [math.nan] * 12), (503, [math.inf] + [0.0] * 11), (504, [0.0] * 12), (505, [])]
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_whitening_of_few_vectors(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, None), (2, [])])).count() == 0
    for vectors in ([(1, [0.5, 0.25, 1.0])], [(1, [0.5, 0.25]), (2, [0.5, 0.25])], [(1, [1.0, 2.0, 3.0, 4.0, 5.0]), (2, [1.0, 2.0, 3.0, 4.0, 9.0])]):
        check(whitening.whiten(table(spark, vectors)).collect(), vectors)


def test_whitening_of_several_lengths(spark):
    rng = np.random.default_rng(3)
    short, long = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((50, 3)))], [(k + 100, v.tolist()) for k, v in enumerate(rng.standard_normal((60, 6)))]
    rows = whitening.whiten(table(spark, short + long)).collect()
    check([r for r in rows if r.vec_id < 100], short)
    check([r for r in rows if r.vec_id >= 100], long)


def test_whitening_of_large_numbers(spark):
    """Far from zero, and beyond what squares of a long hold."""
    rng = np.random.default_rng(4)
    vectors = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((64, 4)) * [40, 30, 20, 10] + 2**14)]
    check(whitening.whiten(table(spark, vectors)).collect(), vectors)
    wide = [(k, (np.array(v) * 2.0**20).tolist()) for k, v in vectors]
    rows = whitening.whiten(table(spark, wide)).collect()
    check(rows, wide)
    assert any(r.deviation is None for r in rows)
    assert whitening.whiten(table(spark, [(1, [3e38, 1.0]), (2, [-3e38, 2.0])])).count() == 4


def made(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        [9, 4, 3, 2, 1, 0.5],
        [5, 5, 5, 5, 5],  # one value, five times
        [4, 4, 3, 3, 1, 0],
        [1 + 1e-12, 1, 1 - 1e-12, 0.5, 0.25],
        [1, 1 - 1e-7, 1 - 2e-7, 1 - 3e-7, 1 - 4e-7, 0.1],
        [1e12, 1, 1e-3, 0, 0],
        [1e-9, 1e-10, 1e-11, 0],
        [3, 2], [7], list(range(200, 0, -1)),
    ],
)
def test_leading_components(values):
    v = made(np.array(values, dtype=float))
    parts = whitening.leading(v, 4)
    top = max(values)
    assert [c.value for c in parts] == pytest.approx(sorted(values, reverse=True)[:4], abs=1e-12 * top)
    u = np.array([c.vector for c in parts])
    assert u @ u.T == pytest.approx(np.eye(len(u)), abs=1e-9)
    for c in parts:
        assert np.linalg.norm(v @ c.vector - c.value * c.vector) <= 1e-11 * top


def test_counts_are_those_of_the_eigenvalues():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        a = rng.standard_normal((9, 9))
        v = a + a.T
        diagonal, side = whitening.tridiagonal(v)
        values = np.linalg.eigvalsh(v)
        for shift in rng.uniform(-6, 6, 30):
            assert whitening.count_above(diagonal, side, shift) == (values > shift).sum()


def test_slices_number_the_components(monkeypatch):
    """Without the counts the iteration finds some eigenvalue, not the k-th."""
    v = made(np.array([9.0, 8, 7, 6, 5, 4, 3, 2, 1]))
    real = whitening.count_above
    monkeypatch.setattr(whitening, "count_above", lambda d, s, shift: real(d, s, shift + 0.35))
    with pytest.raises(ArithmeticError):
        whitening.leading(v, 4)


def test_steps_to_converge(monkeypatch):
    """Cubic: a handful of solves for each component."""
    calls = []
    real = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: calls.append(1) or real(*a))
    whitening.leading(made(np.linspace(20, 1, 64)), 4)
    assert len(calls) <= 4 * 8
