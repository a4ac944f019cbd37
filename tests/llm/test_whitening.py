"""Spectrum slicing against numpy's eigenvalues, and whitening against the definition in plain integers."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("d", [1, 2, 3, 7, 30])
def test_counts_of_an_indefinite_matrix(d):
    r = np.random.default_rng(d)
    for kind in range(6):
        m = r.standard_normal((d, d))
        m = m + m.T if kind < 3 else np.round(m + m.T)
        if kind % 3 == 1:
            np.fill_diagonal(m, 0)
        if kind % 3 == 2:
            m = np.kron(np.diag([1, 0]), m)
        values = np.linalg.eigvalsh(m)
        for shift in (-1.3, 1e-7, 0.7, *(values[:-1] + np.diff(values) / 2)):
            if np.abs(values - shift).min() > 1e-9:
                assert whitening.above(m, shift) == (values > shift).sum()


def spectra():
    yield [9, 4, 2, 1, 0.5, 0.1]
    yield [5, 5, 5, 1, 1]  # multiple eigenvalues
    yield [1, 1, 1, 1, 1, 1]
    yield [3, 3 - 1e-13, 2, 2 - 1e-9, 1]  # nearly so
    yield [7, 0, 0]
    yield [0, 0]
    yield [2.5]
    yield [1e9, 1, 1e-6, 1e-7]
    yield 0.9 ** np.arange(64)


@pytest.mark.parametrize("values", list(spectra()), ids=lambda v: f"{len(v)}-{v[0]}")
def test_leading_eigenvectors(values):
    d = len(values)
    q = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))[0]
    m = (q * np.array(values)) @ q.T
    m = (m + m.T) / 2
    got, vectors = whitening.leading(m, 4)
    scale = max(values)
    assert np.allclose(got, np.linalg.eigvalsh(m)[::-1][:4], rtol=0, atol=1e-13 * scale)
    assert np.allclose(vectors.T @ vectors, np.eye(len(got)), atol=1e-14)
    assert np.allclose(m @ vectors, vectors * got, rtol=0, atol=2e-12 * scale)


def checked(data, got, k=4):
    """The rows of ``whitened`` against sums in exact integers and numpy's eigenvectors."""
    there = [(i, [math.floor(256 * c) for c in v]) for i, v in data]
    fit = sorted({tuple(x) for _, x in there})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in fit])
    values, vectors = np.linalg.eigh(x.T @ x / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    want = sorted(((i, c + 1) for i, _ in there for c in range(len(values))), key=str)
    assert sorted(((r.vec_id, r.component) for r in got), key=str) == want
    deviation = {}
    for i, v in there:
        deviation.setdefault(i, []).append((sum((n * c - s) ** 2 for c, s in zip(v, sums)), v))
    for r in got:
        assert r.n == n and r.identity_error < 1e-9 and r.deviation in {q for q, _ in deviation[r.vec_id]}
        c = r.component - 1
        assert r.explained == pytest.approx(values[c] / (x**2).sum() * n, rel=1e-9)
        own = [abs(np.array([float(Fraction(n * a - s, n)) for a, s in zip(v, sums)]) @ vectors[:, c]) / values[c] ** 0.5 for _, v in deviation[r.vec_id]]
        assert min(abs(abs(r.whitened) - o) for o in own) < 1e-8


def test_whitening_of_vectors(spark):
    r = np.random.default_rng(1)
    data = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(r.standard_normal((300, 6)) * [5, 3, 2, 1, 0.5, 0.1] + 2)]
    data += [(7, data[7][1]), (None, data[9][1]), (400, data[3][1])] + [(500 + i, data[0][1]) for i in range(300)]
    odd = [(900, None), (901, []), (902, [1.0]), (903, [None] * 6), (904, [1.0, 2.0, float("nan"), 1.0, 1.0, 1.0]), (905, [float("inf")] * 6), (906, [1e30] * 6)]
    df = spark.createDataFrame(data + odd, SCHEMA).selectExpr("*", "1 AS x", "2 AS n", "'clash' AS component", "3 AS pos")
    got = whitening.whitened(df).collect()
    checked(data, got)
    w = {(r.vec_id, r.component): r.whitened for r in got if r.vec_id is not None}
    assert all(w[500 + i, c] == w[0, c] for i in range(300) for c in (1, 2, 3, 4))  # one fit, one sign


def test_whitening_of_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    checked([(r.vec_id, r.embedding) for r in df.collect()], whitening.whitened(df).collect())


def test_few_and_equal_vectors(spark):
    make = lambda data: whitening.whitened(spark.createDataFrame(data, SCHEMA)).collect()
    assert make([]) == [] and make([(1, None)]) == [] and make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    line = make([(1, [0.0, 0.0, 1.0]), (2, [1.0, 1.0, 1.0]), (3, [-0.0, 0.0, 1.0])])
    assert [(r.vec_id, r.component, r.n, r.deviation, round(r.explained, 12)) for r in sorted(line)] == [(i, 1, 2, 2 * 256**2, 1.0) for i in (1, 2, 3)]
    assert len({abs(round(r.whitened, 12)) for r in line}) == 1 and len({r.whitened for r in line}) == 2
    assert {r.vec_id for r in make([(1, [1.0]), (2, [2.0]), (3, [1.0, 2.0]), (4, [3.0, 5.0])])} == {1, 2}


def test_large_entries(spark):
    huge = [(1, [2.0**54, 1.0]), (2, [-(2.0**54), 3.0]), (3, [2.0**40, -(2.0**50)])]
    got = whitening.whitened(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()
    assert {r.deviation for r in got} == {None} and {r.n for r in got} == {3} and max(r.identity_error for r in got) < 1e-9
    some = [(1, [2.0**18, 1.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0**17])]
    checked(some, whitening.whitened(spark.createDataFrame(some, "vec_id long, embedding array<double>")).collect(), 2)
