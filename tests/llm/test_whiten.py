"""Whitening: rank-one updates, joined spectra and the whole result against numpy's eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from tessella.llm import queries, whiten
from tessella.llm.common import read

CASES = {
    "random": lambda r: r.normal(size=(300, 12)) @ r.normal(size=(12, 12)) * 100,
    "low rank": lambda r: r.normal(size=(200, 3)) @ r.normal(size=(3, 10)) * 50,
    "axes": lambda r: np.repeat(np.eye(9) * 100, 4, 0),
    "constant": lambda r: np.ones((20, 5)),
    "scales": lambda r: np.concatenate([r.normal(size=(100, 6)) * 1e5, r.normal(size=(100, 6))]),
    "binary": lambda r: r.integers(0, 2, size=(200, 16)),
    "one dimension": lambda r: r.normal(size=(50, 1)) * 100,
}


@pytest.mark.parametrize("case", CASES)
def test_updates_and_joins_keep_the_spectrum(case):
    x = np.floor(CASES[case](np.random.default_rng(7)))
    whole, parts = whiten.Spectrum(x.shape[1]), [whiten.Spectrum(x.shape[1]) for _ in range(3)]
    for i, row in enumerate(x):
        whole.add(row)
        parts[i % 3].add(row)
    parts[0].join(parts[1])
    parts[0].join(parts[2])
    parts[0].join(whiten.Spectrum(x.shape[1]))
    scatter = (x - x.mean(0)).T @ (x - x.mean(0))
    scale = max(np.abs(scatter).max(), 1.0)
    for s in (whole, parts[0]):
        assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
        assert np.abs(s.basis.T @ s.basis - np.eye(x.shape[1])).max() < 1e-12
        assert np.abs(s.basis * s.roots @ s.basis.T - scatter).max() < 1e-12 * scale
        assert np.abs(s.roots - np.linalg.eigvalsh(scatter)).max() < 1e-12 * scale


def test_secular_roots_lie_between_poles():
    r = np.random.default_rng(3)
    poles, weights = np.sort(r.normal(size=20)), r.random(20) ** 8 + 1e-12
    origin, away = whiten._secular_roots(poles, weights)
    roots = poles[origin] + away
    assert (roots > poles).all() and (roots[:-1] < poles[1:]).all() and roots[-1] <= poles[-1] + weights.sum()
    assert np.allclose(np.sort(roots), np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights))), atol=1e-12)


def brute(rows, components=4):
    """``id, component: n, deviation, whitened, explained`` from the definition, signs apart."""
    kept = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[c - s / n for c, s in zip(v, sums)] for v in fit])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, v in kept:
        for k in range(min(components, len(sums))):
            y = np.array([c - s / n for c, s in zip(v, sums)]) @ u[:, k]
            out.append((i, k + 1, n, sum((n * c - s) ** 2 for c, s in zip(v, sums)), abs(y) / math.sqrt(e[k]), e[k] / e.sum()))
    return out


def compare(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), r[1], r[3])) for x in (got, want))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([abs(r.whitened) for r in got], [r[4] for r in want], rtol=1e-9, atol=1e-9)
    assert np.allclose([r.explained for r in got], [r[5] for r in want], rtol=1e-9)
    assert {r.identity_error for r in got} == {got[0].identity_error} and 0 <= got[0].identity_error < 1e-9


@pytest.mark.parametrize(("per", "fan_in"), [(4096, 16), (60, 2)])
def test_query_against_the_definition(spark, monkeypatch, per, fan_in):
    monkeypatch.setattr(whiten, "PER_SPECTRUM", per)
    monkeypatch.setattr(whiten.joined, "__defaults__", (fan_in,))
    small = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in read(spark, small, "embeddings").collect()]
    got = queries.op12_whitening(spark, small).collect()
    assert len(got) == 4 * len(rows)
    compare(got, brute(rows))
    one = [r for r in got if r.component == 1]
    signs = {r.vec_id: r.whitened for r in one}
    assert np.isclose(sum(signs.values()), 0, atol=1e-6)  # distinct here, so the mean is zero with one sign for all


def test_awkward_rows(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(r.normal(size=(60, 6)))]
    rows += [(100, rows[0][1]), (0, rows[0][1]), (101, None), (102, []), (103, [1.0] * 5 + [None]), (104, [float("nan")] * 6), (105, [float("inf")] + [0.0] * 5), (106, [1.0] * 5), (None, rows[3][1]), (107, [0.0] * 6), (108, [-0.0] * 6)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "vec_id long, embedding array<double>, component string, x string")
    compare(whiten.whiten(df).collect(), brute([x for x in rows if x[0] != 106]))


def test_without_variance_and_empty(spark):
    schema = "vec_id string, embedding array<float>"
    assert whiten.whiten(spark.createDataFrame([], schema)).count() == 0
    assert whiten.whiten(spark.createDataFrame([("a", None)], schema)).count() == 0
    same = whiten.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], schema)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, None)] * 4
    line = whiten.whiten(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [2.0, 4.0]), ("c", [4.0, 8.0])], schema)).collect()
    assert [(r.whitened is None, round(r.explained, 12)) for r in line] == [(False, 1.0), (True, 0.0)] * 3
    huge = whiten.whiten(spark.createDataFrame([("a", [1e30, 1.0]), ("b", [-1e30, 2.0]), ("c", [0.0, 3.0])], schema)).collect()
    assert len(huge) == 6 and all(r.deviation is None for r in huge if r.vec_id != "c")
