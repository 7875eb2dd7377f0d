"""Whitening: against numpy on small tables, exact parts against Python integers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tallyspark.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, component string"


def by_hand(rows):
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in rows}
    fit = sorted(set(map(tuple, x.values())))
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    v = np.cov(np.array(fit, float).T, bias=True)
    values, vectors = np.linalg.eigh(v)
    top = [(values[-k], vectors[:, -k]) for k in range(1, 5) if values[-k] > 1e-9 * values[-1]]
    out = {}
    for i, c in x.items():
        deviation = sum((n * a - b) ** 2 for a, b in zip(c, s, strict=True))
        for k, (e, u) in enumerate(top, 1):
            out[i, k] = (n, deviation, (np.array(c) - np.array(s) / n) @ u / math.sqrt(e), e / np.trace(v))
    return out


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 7)) * [3, 2, 1.5, 1, 0.8, 0.5, 0.3] + 4
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(200)]  # one vector many times: once in the fit list
    bad = [(900, None), (901, [1.0, None] + [0.0] * 5), (902, [float("nan")] + [0.0] * 6), (903, [float("inf")] * 7), (904, []), (905, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], SCHEMA)
    got = W.whitened(df).collect()
    want = by_hand(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, w, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.explained - share) < 1e-12 and r.identity_error < 1e-9
        sign.setdefault(r.component, math.copysign(1, r.whitened * w)) if abs(w) > 0.1 else None
        assert abs(r.whitened - sign.get(r.component, 1) * w) < 1e-8 or abs(w) <= 0.1


def test_whitening_of_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whitened(empty).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0], "x") for i in range(3)], SCHEMA)
    assert W.whitened(same).count() == 0
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "x") for i in range(5)] + [(None, [1.0, 2.0, 0.0], "x")], SCHEMA)
    got = W.whitened(line).collect()
    assert len(got) == 6 and all(r.component == 1 and abs(r.explained - 1) < 1e-12 for r in got)
    huge = spark.createDataFrame([(i, [1e30 * (i - 1), float(i)], "x") for i in range(3)], SCHEMA)
    assert {r.deviation for r in W.whitened(huge).collect()} <= {None, 0, 1}  # the range of long has one number more below zero


def test_equal_variances_give_orthogonal_components(spark):
    rows = [(i, [float(a), float(b), float(c)], "x") for i, (a, b, c) in enumerate((a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1))]
    got = W.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.component for r in got} == {1, 2, 3} and max(r.identity_error for r in got) < 1e-12
    assert all(abs(r.explained - 1 / 3) < 1e-12 for r in got)


def test_exact_parts():
    rng = random.Random(3)
    for top in (5, 1 << 19, 1 << 30, (1 << 63) - 1):
        x = np.array([[rng.randint(-top, top) for _ in range(4)] for _ in range(50)], np.int64)
        want = x.astype(object).T @ x.astype(object)
        assert (W.exact_products(x) == want).all()
        assert (sum(w.astype(object) << 32 * k for k, w in enumerate(W._words(want.ravel()))) == want.ravel()).all()
    m = np.array([[2, 1, 0], [1, 2, 0], [0, 0, 3]], object)  # roots 1, 3, 3
    p = W.primes(3)
    assert [int(c) if c < p[0] // 2 else int(c) - p[0] for c in W.polynomial_mod(m, p[0])] == [-9, 15, -7, 1]
    assert [r / 2**64 for r in W.largest_roots([-9, 15, -7, 1], 4, 64)] == pytest.approx([3, 3, 1])
    assert W.roots_above([-9, 15, -7, 1], 1) == 2 and W.roots_above([-9, 15, -7, 1], 0) == 3
    zeros = np.zeros((3, 3), object)
    zeros[0, 2] = zeros[2, 0] = 5  # a pivot must be looked for
    assert [int(c) % p[0] for c in W.polynomial_mod(zeros, p[0])] == [0, -25 % p[0], 0, 1]


def test_close_roots_keep_their_components(spark):
    """Variances that differ by a part in 10**12 are told apart, beyond what doubles resolve well."""
    a, q = 10**12, np.array([[3, 4], [-4, 3]], object)
    m = q.T @ np.diag(np.array([a + 1, a], object)) @ q
    poly = W.characteristic_polynomial(spark, m)
    roots = W.largest_roots(poly, 2, 200)
    assert abs(roots[0] - roots[1] - (25 << 200)) <= 1
    v = W.null_vectors(m, roots, 200)
    assert np.abs(np.abs(v[:, 0]) - [0.6, 0.8]).max() < 1e-15 and abs(v[:, 0] @ v[:, 1]) < 1e-15
