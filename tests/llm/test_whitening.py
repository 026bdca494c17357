"""Whitened amounts against a dense eigensolver, and the solver against hard spectra."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from restomart.llm import whitening as W
from restomart.sources.star_adapter import silver_from_star

SCHEMA = "id long, amounts array<double>, steps string, row string, scores long, component string, n long"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "s", "r", 1, "c", 2) for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, k=4):
    """Steps of each usable (id, vector), distinct steps, eigenvalues and vectors by a dense solver."""
    used = [(i, [math.floor(256 * c) for c in v]) for i, v in vectors
            if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array(sorted({tuple(v) for _, v in used}))
    values, axes = np.linalg.eigh(np.cov(x.T, bias=True))
    return used, x, values[::-1][:k], axes.T[::-1][:k]


def check(found, vectors, k=4):
    used, x, values, axes = plain(vectors, k)
    got, n, sums = {}, len(x), x.sum(axis=0)
    for r in found.collect():
        got.setdefault((r["id"], r["deviation"]), []).append(r)
    variance = x.var(axis=0).sum()
    signs = {}
    wanted = [(i, sum((n * a - int(s)) ** 2 for a, s in zip(v, sums)), v) for i, v in used]
    assert sorted(((i, d) for i, d, _ in wanted for _ in range(k)), key=str) == sorted(
        ((i, d) for (i, d), rows in got.items() for _ in rows), key=str)
    for i, deviation, v in wanted:
        plain_scores = axes @ (np.array(v) - sums / n) / np.sqrt(values)
        rows = sorted(got[i, deviation], key=lambda r: r["component"])
        for r in rows:
            c = r["component"] - 1
            want = plain_scores[c]
            if abs(want) > 1e-6:
                sign = signs.setdefault(c, math.copysign(1, want * r["whitened"]))
                assert math.isclose(r["whitened"], sign * want, rel_tol=1e-7, abs_tol=1e-8)
            assert r["n"] == n and math.isclose(r["explained"], values[c] / variance, rel_tol=1e-9)
            assert r["identity_error"] < 1e-9
    assert set(signs) == set(range(k))


def sample(n, d, seed=0):
    rng = np.random.default_rng(seed)
    return [[float(c) for c in row] for row in rng.standard_normal((n, d)) * np.linspace(3, 0.5, d) + 40]


AWKWARD = [(900, None), (901, []), (902, [1.0, None] + [0.0] * 6), (903, [float("nan")] + [0.0] * 7),
           (904, [float("inf")] + [0.0] * 7), (905, [float("-inf")] * 8), (906, [None] * 8), (None, [-0.0] * 8),
           (907, [-0.001] + [40.0] * 7), (907, [-0.001] + [40.0] * 7)]


def test_whitening_equals_a_dense_solver(spark):
    vectors = list(enumerate(sample(150, 8))) + AWKWARD
    vectors += [(1_000 + i, vectors[7][1]) for i in range(120)]  # copies count once in the fit
    found = W.whitened_amounts(table(spark, vectors))
    assert found.columns == ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    check(found, vectors)
    other = table(spark, vectors + [(2_000, [1.0, 2.0]), (2_001, [0.5] * 9)])
    assert W.whitened_amounts(other).filter("id >= 2000").isEmpty()


def test_whitening_of_few_dimensions(spark):
    vectors = list(enumerate(sample(40, 2)))
    check(W.whitened_amounts(table(spark, vectors)), vectors, 2)
    flat = [(i, [float(i % 9), 2.0 * (i % 9), 5.0]) for i in range(40)]
    found = W.whitened_amounts(table(spark, flat))
    assert {r["component"] for r in found.collect()} == {1}


def test_whitening_of_nothing_to_scale(spark):
    assert W.whitened_amounts(table(spark, [])).count() == 0
    assert W.whitened_amounts(table(spark, [(1, None), (2, [])])).count() == 0
    assert W.whitened_amounts(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_whitening_of_amounts_beyond_64_bits(spark):
    big = [(1, [1e12, 0.0]), (2, [-1e12, 1.0]), (3, [3e11, 1e10])]
    rows = {r["id"]: r for r in W.whitened_amounts(table(spark, big)).filter("component = 1").collect()}
    assert set(rows) == {1, 2, 3} and rows[1]["deviation"] is None
    near = [(1, [2.0 ** 20, 0.0]), (2, [0.0, 1.0]), (3, [-5.0, 2.0])]
    check(W.whitened_amounts(table(spark, near)), near, 2)


def test_whitening_of_stored_orders(spark, sf_dir):
    orders = W.order_amounts(silver_from_star(spark, sf_dir).orders)
    found = W.whitened_amounts(orders)
    best = found.groupBy("component").agg(F.count("*").alias("n"), F.max("identity_error").alias("e"))
    assert all(r["e"] < 1e-4 for r in best.collect()) and best.count() >= 1


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["random", "equal", "low rank", "clusters", "nil", "split", "graded"])
def test_components_of_hard_spectra(d, kind):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    spectrum = {"random": rng.random(d) + 0.1, "equal": np.full(d, 7.0), "low rank": np.eye(d)[0] * 3,
                "clusters": np.round(rng.random(d) * 2) + 1 + 1e-9 * rng.random(d), "nil": np.zeros(d),
                "split": np.arange(d) + 1.0, "graded": 10.0 ** -np.arange(d)}[kind]
    a = np.diag(spectrum) if kind in ("split", "graded") else (q * spectrum) @ q.T
    a = (a + a.T) / 2
    k = min(4, d)
    values, axes = W.principal_components(a, k)
    size = max(np.abs(a).max(), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1][:k]).max() <= 1e-13 * size
    assert np.abs(axes @ axes.T - np.eye(k)).max() < 1e-12
    assert np.abs(a @ axes.T - axes.T * values).max() <= 1e-12 * size


def test_sturm_counts_and_tridiagonal_form():
    rng = np.random.default_rng(5)
    a = rng.standard_normal((30, 30))
    a = a + a.T
    diagonal, off, _ = W.tridiagonal(a)
    t = np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1)
    values = np.linalg.eigvalsh(a)
    assert np.allclose(np.linalg.eigvalsh(t), values)
    assert W.below(diagonal, off, np.array([values[0] - 1, *(values[:-1] + values[1:]) / 2, values[-1] + 1])).tolist() == list(range(31))
