"""Whitening against exact fractions and numpy's eigenvectors; counts, clusters and odd vectors."""

import math
from collections import defaultdict
from decimal import Decimal

import numpy as np
import pytest

from daygrid.llm.whitening import Factors, Spectrum, leading, whiten

RNG = np.random.default_rng(11)


def symmetric(values):
    q, _ = np.linalg.qr(RNG.standard_normal((len(values), len(values))))
    return (q * np.array(values)) @ q.T


@pytest.mark.parametrize("n", [1, 2, 3, 10, 40])
def test_inertia_counts_and_solutions(n):
    for _ in range(20):
        a = RNG.standard_normal((n, n))
        a = a + a.T
        if n > 2:
            a[np.diag_indices(n)] *= RNG.integers(0, 2, n)  # zero diagonals need pivots of two rows
        f = Factors(a)
        assert f.positive == (np.linalg.eigvalsh(a) > 0).sum()
        b = RNG.standard_normal(n)
        assert np.allclose(a @ f.solve(b), b, atol=1e-6 * max(1, np.linalg.cond(a) * 1e-6))


@pytest.mark.parametrize(
    "values",
    [
        [5, 4, 3, 2, 1], [1e6, 1, 1e-6, 1e-9], [3, 3, 3, 1, 1, 0.5], [2, 2 - 1e-9, 2 - 2e-9, 1], [1, 0, 0, 0], [7],
        [1 + 1e-14, 1, 1 - 1e-14, 0.1], list(range(30, 0, -1)), [9, 8, *[1e-3] * 10],
    ],
    ids=range(9),
)
def test_leading_vectors(values):
    a = symmetric(values)
    a = (a + a.T) / 2
    found, vectors = leading(a, 8)
    m, size = min(8, len(values)), max(values)
    assert np.allclose(found, sorted(values, reverse=True)[:m], rtol=0, atol=1e-13 * size * len(values))
    assert np.abs(vectors @ vectors.T - np.eye(m)).max() < 1e-13
    assert np.abs(a @ vectors.T - vectors.T * found).max() < 1e-12 * size


def test_counts_certify_numbers():
    spectrum = Spectrum(symmetric([4.0, 3.0, 2.0, 1.0]))
    for k in range(1, 4):
        spectrum.next()
        value = spectrum.values[-1]
        assert spectrum.above(value - 1e-9) == k and spectrum.above(value + 1e-9) == k - 1


def plain(rows, components=8):
    """Exact integers in Python, eigenvectors by numpy."""
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * c) + 100000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    total = [sum(r[j] for r in x) for j in range(d)]
    centred = [[n * r[j] - total[j] for j in range(d)] for r in x]
    cov = np.array([[sum(r[i] * r[j] for r in centred) / n**3 for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    order = np.argsort(-e)[:components]
    w = (np.array(centred, float) / n) @ v[:, order] / np.sqrt(np.maximum(e[order], 1e-300))
    return good, n, [sum(c * c for c in r) for r in centred], w, e[order] / np.trace(cov), e[order]


def compared(spark, rows, kind="float", **more):
    out = defaultdict(list)
    docs = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, VECTOR int, n string")
    for r in whiten(docs.repartition(5), **more).collect():
        out[r["vec_id"]].append(r)
    good, n, deviation, w, explained, e = plain(rows)
    assert set(out) == {i for i, _ in good}
    signs = {}
    for k, (i, _) in enumerate(good):
        for r in sorted(out[i], key=lambda r: r["component"]):
            c = r["component"] - 1
            assert r["n"] == n and r["deviation"] == deviation[k]
            assert math.isclose(r["explained"], explained[c], rel_tol=1e-9, abs_tol=1e-12)
            if r["whitened"] is None:
                assert explained[c] < 1e-12
                continue
            s = signs.setdefault(c, 1 if r["whitened"] * w[k, c] > 0 else -1)
            assert math.isclose(s * r["whitened"], w[k, c], rel_tol=1e-6, abs_tol=1e-7) and r["identity_error"] < 1e-9
    return out


def test_vectors(spark):
    axes = symmetric(np.linspace(2, 0.1, 12))
    rows = [(i, (RNG.standard_normal(12) @ axes).astype(np.float32).tolist()) for i in range(400)]
    out = compared(spark, rows)
    assert all(len(r) == 8 for r in out.values())


def test_odd_vectors(spark):
    rows = [(i, RNG.standard_normal(3).tolist()) for i in range(40)]
    rows += [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [1.0, math.nan, 2.0]), (104, [math.inf, 0.0, 0.0]),
        (105, [None] * 3), (7, rows[7][1]),
    ]
    docs = rows[:-1]
    out = compared(spark, docs, "double")
    assert all(len(r) == 3 for r in out.values())
    again = spark.createDataFrame([*rows, (None, [1.0, 2.0, 3.0]), (200, [1.0, 2.0]), (201, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>")
    got = whiten(again).collect()
    assert {r["n"] for r in got} == {42} and sum(r["vec_id"] == 7 for r in got) == 6
    assert {r["vec_id"] for r in got} == {*range(40), None}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(RNG.integers(-(2**40), 2**40)), float(RNG.standard_normal()), 3e5 * i, 5.0]) for i in range(30)]
    out = compared(spark, rows, "double")
    assert all(isinstance(r["deviation"], Decimal) and r["whitened"] is None for v in out.values() for r in v if r["component"] == 4)


def test_equal_vectors_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    got = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], kind)).collect()
    assert len(got) == 4
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["deviation"] == 0 for r in got)
    assert whiten(spark.createDataFrame([], kind)).collect() == []
    assert whiten(spark.createDataFrame([(1, None)], kind)).collect() == []
