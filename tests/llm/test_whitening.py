import math
import random

import numpy as np
import pytest

from veritally.llm import whitening


def upper(diagonal, above):
    return np.diag(diagonal) + np.diag(above, 1)


@pytest.mark.parametrize("d", [1, 2, 3, 8, 33, 64])
def test_singular_values_and_directions_against_numpy(d):
    r = np.triu(np.random.default_rng(d).standard_normal((d, d)))
    values, axes, squares = whitening.directions(r, min(8, d))
    want = np.linalg.svd(r, compute_uv=False) ** 2
    assert np.allclose(values, want, rtol=1e-11, atol=1e-14 * want[0])
    assert np.allclose(squares, want[: len(squares)], rtol=1e-12)
    assert np.abs(axes @ axes.T - np.eye(len(axes))).max() < 1e-12
    gram = r.T @ r
    for v, e in zip(axes, squares, strict=True):
        assert np.abs(gram @ v - e * v).max() < 1e-13 * want[0] * d


def test_small_values_keep_their_digits():
    # The squared values multiply to the squared determinant, which the diagonal gives exactly.
    pick = np.random.default_rng(4)
    for _ in range(20):
        d = 12
        diagonal = 10.0 ** -np.sort(pick.uniform(0, 12, d)) * pick.choice([-1, 1], d)
        above = 10.0 ** -pick.uniform(0, 12, d - 1)
        values = whitening.dqds(diagonal, above)
        assert (values > 0).all() and (np.diff(values) <= 0).all()
        log = 2 * sum(math.log(abs(x)) for x in diagonal)
        assert abs(sum(map(math.log, values)) - log) < 1e-11
        graded = whitening.dqds(diagonal[::-1], above[::-1])
        assert np.allclose(graded, whitening.dqds(diagonal[::-1].copy(), above[::-1].copy()), rtol=0)


def test_equal_zero_and_close_values():
    q, _ = np.linalg.qr(np.random.default_rng(2).standard_normal((20, 20)))
    for spectrum in ([5.0] * 20, [3, 3, 3, 2, 2, 1] + [0] * 14, [1 + 1e-12 * i for i in range(20)], [0] * 20, [7] + [1e-9] * 19):
        r = np.linalg.qr(q * np.array(spectrum, float)[:, None].T @ np.eye(20) @ q.T, mode="r")
        values, axes, squares = whitening.directions(r, 8)
        want = np.sort(np.array(spectrum, float) ** 2)[::-1]
        assert np.allclose(values, want, rtol=1e-9, atol=1e-14 * max(want[0], 1e-300))
        if want[7] > 1e-10 * want[0] and want[0] > 0:
            assert np.abs(axes @ axes.T - np.eye(8)).max() < 1e-10
            assert np.allclose(squares, want[:8], rtol=1e-9)
    assert whitening.dqds(np.array([2.0, 0.0, 3.0]), np.array([1.0, 1.0]))[-1] == 0
    assert whitening.dqds(np.zeros(3), np.zeros(2)).tolist() == [0, 0, 0]
    block = upper([2.0, 1.0, 2.0, 1.0], [0.5, 0.0, 0.5])
    assert np.allclose(whitening.dqds(np.diag(block), np.diag(block, 1)), np.linalg.svd(block, compute_uv=False) ** 2, rtol=1e-12)


def brute(rows):
    x = [(i, [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]) for i, v in rows]
    n, d = len(x), len(x[0][1])
    sums = [sum(v[j] for _, v in x) for j in range(d)]
    centred = np.array([[v[j] - sums[j] / n for j in range(d)] for _, v in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    deviation = {i: sum((n * v[j] - sums[j]) ** 2 for j in range(d)) for i, v in x}
    return n, deviation, centred @ axes / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


def test_rows_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FOLD", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    pick = random.Random(6)
    scales = [pick.uniform(0.05, 3) for _ in range(12)]
    good = [(i, [pick.gauss(0.3, s) for s in scales]) for i in range(90)]
    good += [(i, v) for i, v in good[:5]]  # repeated rows
    bad = [(500, None), (501, [None] + [0.0] * 11), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, [1.0] * 5), (505, []), (506, [1e35] * 12)]
    frame = spark.createDataFrame(good + bad, "vec_id long, embedding array<float>").selectExpr("*", "'x' n", "1 component").repartition(7)
    got = whitening.whiten(frame, components=8).collect()
    n, deviation, whitened, shares = brute(good)
    assert len(got) == 8 * len(good) and {r.n for r in got} == {n} and {r.vec_id for r in got} == set(range(90))
    assert all(int(r.deviation) == deviation[r.vec_id] for r in got)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-12
    place = {i: k for k, (i, _) in enumerate(good)}
    for c in range(1, 9):
        of = [r for r in got if r.component == c]
        assert len(of) == len(good) and all(abs(r.explained - shares[c - 1]) < 1e-12 for r in of)
        ours, theirs = np.array([r.whitened for r in of]), np.array([whitened[place[r.vec_id], c - 1] for r in of])
        assert min(np.abs(ours - theirs).max(), np.abs(ours + theirs).max()) < 1e-10


def test_tables_without_directions(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [])], [(1, [float("nan")])], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 3):
        got = whitening.whiten(frame(rows))
        assert got.columns == whitening.COLUMNS and got.count() == 0
    two = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (None, [4.0, 2.0])])).collect()
    assert {r.component for r in two} == {1} and len(two) == 3 and abs(two[0].explained - 1) < 1e-12


def test_exact_deviation_beyond_64_bits():
    x = np.array([[1 << 35, 0], [0, 1 << 39]])
    sums = np.array([1 << 35, 1 << 39], object)
    n = 1 << 20
    want = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    assert whitening._exact_deviation(x, n, sums) == want and max(want) > 1 << 100
    assert whitening._exact_deviation(np.array([[3, 0]]), 2, np.array([5, 7], object)) == [1 + 49]
