import math

import numpy as np
import pytest
from tablemill.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label string, n string, whitened double"


def matrices():
    draw = np.random.default_rng(3)
    turn, _ = np.linalg.qr(draw.normal(size=(40, 40)))
    for spectrum in (np.linspace(1, 9, 40), np.logspace(0, -9, 40), np.repeat([5.0, 1.0], 20), np.array([1.0] + [1e-9] * 39), np.array([3.0, 2.0] + [0.0] * 38)):
        made = turn * spectrum @ turn.T
        yield (made + made.T) / 2
    for n in (1, 2, 3, 17):
        x = draw.normal(size=(2 * n, n))
        yield x.T @ x
    yield from (np.eye(5), np.zeros((3, 3)), np.ones((6, 6)), np.diag([4.0, 0, 0, 2, 2]), np.array([[2.0, 1], [1, 2]]))


def test_eigenvectors():
    for a in matrices():
        values, vectors = whitening.components(a)
        size = max(1e-300, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], atol=1e-13 * size * len(a), rtol=1e-13)
        assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-12
        assert np.abs(a @ vectors - vectors * values).max() < 1e-13 * size * len(a)


def test_polar():
    draw = np.random.default_rng(1)
    turn, _ = np.linalg.qr(draw.normal(size=(30, 30)))
    spectrum = np.concatenate((np.logspace(0, -12, 15), -np.logspace(0, -12, 15)))
    factor = whitening.polar(turn * spectrum @ turn.T)
    assert np.abs(factor @ factor - np.eye(30)).max() < 1e-12
    assert np.trace(factor) == pytest.approx(0, abs=1e-9)


def odd_rows(n=200, dim=12):
    draw = np.random.default_rng(7)
    x = draw.normal(size=(n, dim)) @ draw.normal(size=(dim, dim)) + 3
    rows = [(i, [float(np.float32(v)) for v in row], "l", "n", 0.5) for i, row in enumerate(x)]
    rows += [rows[3]] * 5 + [(None, rows[4][1], None, None, None)]
    rows += [(900, None, "l", "n", 0.0), (901, [], "l", "n", 0.0), (902, [math.nan] * dim, "", "", 0.0), (903, [None] + [1.0] * (dim - 1), "", "", 0.0)]
    return rows + [(904, [math.inf] * dim, "", "", 0.0), (905, [3e38] * dim, "", "", 0.0)]


def by_hand(rows, k):
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) and abs(c) < 1e16 for c in v)]
    n, sums = len(good), [sum(c) for c in zip(*(x for _, x in good), strict=True)]
    centred = np.array([[n * a - s for a, s in zip(x, sums, strict=True)] for _, x in good]) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    turned = centred @ vectors[:, :k] / np.sqrt(values[:k])
    exact = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for _, x in good]
    return [i for i, _ in good], n, exact, turned, values[:k] / values.sum()


@pytest.mark.parametrize("k", [5, 32])
def test_whitened(spark, k):
    rows = odd_rows()
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5), k).collect()
    ids, n, exact, turned, explained = by_hand(rows, k)
    width = turned.shape[1]
    assert len(found) == len(ids) * width and {r["n"] for r in found} == {n}
    by_row = {}
    for r in found:
        by_row.setdefault((r["vec_id"], r["deviation"], r["component"]), set()).add(round(r["whitened"], 9))
        assert r["explained"] == pytest.approx(explained[r["component"] - 1], rel=1e-10) and r["identity_error"] < 1e-9
    sign = {}
    for row, (i, d) in enumerate(zip(ids, exact, strict=True)):
        for c in range(width):
            (value,) = by_row[i, d, c + 1]
            if c not in sign and abs(value) > 0.1:
                sign[c] = math.copysign(1, value) * math.copysign(1, turned[row, c])
    for row, (i, d) in enumerate(zip(ids, exact, strict=True)):
        for c in range(width):
            (value,) = by_row[i, d, c + 1]
            assert value == pytest.approx(sign[c] * turned[row, c], abs=1e-7)


def test_wide_numbers(spark):
    """Sums beyond 64 bits: exact where the result holds them, null where it does not."""
    rows = [(i, [float(1 << 54) * (i % 3), float(i)]) for i in range(9)] + [(9, [1.0, 2.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in found} == {None} and {r["n"] for r in found} == {10}


def test_without_variance(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
    flat = [(i, [1.0, float(i)]) for i in range(4)] + [(9, [1.0, 1.0, float(i)]) for i in range(3)]
    found = whitening.whiten(spark.createDataFrame(flat, "vec_id long, embedding array<float>")).collect()
    assert sorted((r["n"], r["component"]) for r in found) == [(3, 1)] * 3 + [(4, 1)] * 4
