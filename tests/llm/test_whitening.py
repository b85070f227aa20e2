"""Whitening against a plain eigendecomposition."""

import math

import numpy as np
import pytest

from passagework.llm import whitening


def plain(rows, components=16):
    """(id, component) to (n, deviation, whitened, explained) with exact sums; rows of one length."""
    x = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centre = lambda v: np.array([(n * c - s) / n for c, s in zip(v, sums)])
    covariance = sum(np.outer(centre(v), centre(v)) for v in fit) / n
    values, vectors = np.linalg.eigh(covariance)
    order = [k for k in np.argsort(-values)[:components] if values[k] > whitening.LEAST_SHARE * values.max()]
    out = []
    for i, v in x:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        for at, k in enumerate(order, 1):
            out.append((i, at, n, deviation, centre(v) @ vectors[:, k] / math.sqrt(values[k]), values[k] / np.trace(covariance)))
    return out


def compare(got, want):
    found = sorted((r.vec_id, r.component, r.n, int(r.deviation), abs(r.whitened), r.explained) for r in got)
    assert len(found) == len(want)
    for g, w in zip(found, sorted((*x[:4], abs(x[4]), x[5]) for x in want)):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-8, abs=1e-8) and g[5] == pytest.approx(w[5], rel=1e-9)
    assert all(r.identity_error < 1e-9 for r in got)


@pytest.mark.parametrize("values", [64, 65_536])
def test_rows_equal_plain_whitening(spark, monkeypatch, values):
    """Small blocks make many of them, so that folding and splits matter."""
    monkeypatch.setattr(whitening, "BLOCK_VALUES", values)
    pick = np.random.default_rng(3)
    rows = [(k, (pick.normal(size=20) * np.linspace(1, 2, 20)).tolist()) for k in range(240)]
    rows += [(1000 + k, rows[k % 3][1]) for k in range(100)]
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, n int, block string")
    got = whitening.whiten(frame).collect()
    compare(got, plain(rows))
    signs = {}
    for r in got:
        signs.setdefault((r.vec_id, r.component), r.whitened)
    assert all(signs[1000 + k, 1] == signs[k % 3, 1] for k in range(100))


def test_odd_vectors_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, 2.0]), (2, [1.5, 0.25, -2.0]), (3, [0.5, 1.0, 2.0]), (4, [-3.0, 1.0, 0.5])]
    other = [(11, [1.0, 2.0]), (12, [2.0, 4.5]), (13, [0.0, 1.0])]
    spoilt = [(20, None), (21, [1.0, None, 2.0]), (22, [nan, 1.0, 1.0]), (23, [inf, 0.0, 0.0]), (24, []), (25, [1.0]), (26, [1.0]), (27, [1e30, 1.0, 1.0])]
    got = whitening.whiten(spark.createDataFrame(good + other + spoilt, "vec_id long, embedding array<float>")).collect()
    assert {r.vec_id for r in got} == {1, 2, 3, 4, 11, 12, 13}
    compare([r for r in got if r.vec_id < 10], plain(good))
    compare([r for r in got if r.vec_id > 10], plain(other))
    assert max(r.component for r in got if r.vec_id < 10) == 2  # three distinct vectors span a plane


def test_no_rows_and_large_values(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0
    pick = np.random.default_rng(5)
    rows = [(k, (pick.normal(size=3) * 2.0**30).tolist()) for k in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    compare(got, plain(rows))
    x = np.array([[2**40, -(2**40)], [5, 7]])
    sums = (3 * 2**40, -(2**41))
    assert whitening.deviations(x, 2**30, sums).tolist() == [[2**30 * int(v) - s for v, s in zip(r, sums)] for r in x]
