import math

import numpy as np
import pytest
from tablemill.llm import ball_tree, block_neighbours

SCHEMA = "vec_id long, embedding array<float>, block string, score string"


def vectors(n, dim=6, seed=3):
    draw = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(v)) for v in draw.normal(size=dim)], "b", "s") for i in range(n)]
    rows += [(i + n, rows[7][1], "b", "s") for i in range(30)]  # ties
    rows += [(7, rows[7][1], "b", "s"), (20, rows[3][1], None, None), (None, rows[1][1], "b", "s")]
    rows += [(2000, None, "b", "s"), (2020, [], "b", "s"), (2040, [0.0] * dim, "b", "s"), (2060, [math.nan] * dim, "b", "s")]
    rows += [(2080, [math.inf] + [1.0] * (dim - 1), "b", "s"), (2100, [None] + [1.0] * (dim - 1), "b", "s"), (2120, [1.0, 2.0], "b", "s"), (2121, [3.0, 1.0], "b", "s")]
    return rows


def by_hand(rows, every, k, turn, zeros):
    good = [(i, turn(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (zeros or any(v))]
    out = []
    for n, (i, q) in enumerate(good):
        if i % every == 0:
            scores = []
            for m, (j, c) in enumerate(good):
                if m != n and len(c) == len(q):
                    total = 0
                    for a, b in zip(q, c, strict=True):
                        total += a * b
                    scores.append((-total, j))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize(("tile_rows", "tile_queries"), [(4096, 4096), (40, 8)])
def test_nearest(spark, tile_rows, tile_queries):
    rows = vectors(150)
    found = block_neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 20, 20, tile_rows, tile_queries)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, 20, 20, list, False)


@pytest.mark.parametrize(("shard_rows", "leaf_rows"), [(8192, 128), (30, 8)])
def test_top_k(spark, shard_rows, leaf_rows):
    rows = vectors(150)
    found = ball_tree.top_k(spark.createDataFrame(rows, SCHEMA), 20, 10, shard_rows, leaf_rows)
    wanted = by_hand(rows, 20, 10, lambda v: [math.floor(1024 * x) for x in v], True)
    assert sorted(tuple(r) for r in found.collect()) == wanted


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert block_neighbours.nearest(none).count() == 0
    assert ball_tree.top_k(none).count() == 0


def test_bounds_hold():
    x = np.random.default_rng(5).normal(size=(200, 32)) * np.array([1e-3] * 100 + [50.0] * 100)[:, None]
    codes, scale, error, near = block_neighbours.quantised(x)
    middle = block_neighbours.int8_products(codes, codes) * scale[:, None] * scale
    reach = np.linalg.norm(x, axis=1)[:, None] * error + error[:, None] * near
    assert (np.abs(middle - x @ x.T) <= reach * (1 + 1e-9) + 1e-9 * np.abs(middle)).all()


def test_balls_hold_their_rows():
    x = np.random.default_rng(6).normal(size=(500, 8))
    x[[3, 400], 2] = 1e300
    tree = ball_tree.build(x, 16)
    assert sorted(tree.rows.tolist()) == list(range(500)) and sorted(tree.wild().tolist()) == [3, 400]
    leaves = []
    for centre, radius, (left, right, start, end) in zip(tree.centres, tree.radii, tree.links, strict=True):
        assert (np.linalg.norm(x[tree.rows[start:end]] - centre, axis=1) <= radius).all()
        if left < 0:
            leaves += range(start, end)
        else:
            assert [tree.links[left][2], tree.links[left][3], tree.links[right][3]] == [start, tree.links[right][2], end]
    assert sorted(leaves) == list(range(498))


def test_subtrees_are_pruned():
    draw = np.random.default_rng(8)
    x = np.concatenate([draw.normal(size=(100, 8)) + 30 * draw.normal(size=8) for _ in range(40)])
    tree = ball_tree.build(ball_tree.scaled(x), 16)
    search = ball_tree.Search(tree, x, np.arange(len(x)), x[:50], np.arange(50), np.full(50, ball_tree.LONG.min), 10)
    search.run()
    assert search.seen < 50 * len(tree.links) / 3
    scores = ball_tree.products(x[:50], x)
    for i in range(50):
        order = [j for j in np.lexsort((np.arange(len(x)), -scores[i])) if j != i][:10]
        assert search.rows[i].tolist() == order


def test_large_products():
    big, small = np.array([[2.0**20, 5.0, -7.5]]), np.array([[1.0, -0.25, 0.1]])
    both = np.concatenate((big, small, big * 2.0**40, [[1e300, -1e300, 1e308]]))
    whole = [[math.floor(v * 1024) if abs(v) < 1e300 else int(v) * 1024 for v in row] for row in both.tolist()]
    wanted = [[min(max(sum(v * w for v, w in zip(a, b, strict=True)), -(2**63)), 2**63 - 1) for b in whole] for a in whole]
    assert ball_tree.products(both, both).tolist() == wanted


HUGE = [1e300, 3e15, -3e15, 1e-200, 1e154, 1e308, -1e300, 5e-324]


@pytest.mark.parametrize("size", [8192, 40])
def test_any_finite_vector(spark, size):
    draw = np.random.default_rng(11)
    rows = [(i, draw.normal(size=4).tolist(), "b", "s") for i in range(100)]
    rows += [(1000 + 20 * i, [h, *draw.normal(size=3).tolist()], "b", "s") for i, h in enumerate(HUGE)]
    rows += [(2000 + i, [1e300, -1e300, 0.5, float(i)], "b", "s") for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string, score string")
    found = sorted(tuple(r) for r in ball_tree.top_k(df, 20, 10, size, 8).collect())
    whole = {i: [math.floor(v * 1024) if abs(v) < 2.0**60 else int(v) * 1024 for v in x] for i, x, *_ in rows}
    wanted = []
    for q in whole:
        if q % 20 == 0:
            scores = [(-min(max(sum(v * w for v, w in zip(whole[q], x, strict=True)), -(2**63)), 2**63 - 1), i) for i, x in whole.items() if i != q]
            wanted += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:10], 1)]
    assert found == sorted(wanted)
    near = sorted((tuple(r) for r in block_neighbours.nearest(df, 20, 20, size, 8).collect()), key=lambda r: r[:2])
    wanted = []
    for q, x, *_ in sorted(rows):
        if q % 20 == 0:
            scores = []
            for i, y, *_ in rows:
                total = 0.0
                for a, b in zip(x, y, strict=True):
                    total += a * b
                if i != q:
                    scores.append((not math.isnan(total), 0.0 if math.isnan(total) else -total, i))
            wanted += [(q, r, i, -s if number else math.nan) for r, (number, s, i) in enumerate(sorted(scores)[:20], 1)]
    assert [r[:3] for r in near] == [r[:3] for r in wanted]
    assert all(a[3] == b[3] or math.isnan(a[3]) and math.isnan(b[3]) for a, b in zip(near, wanted, strict=True))


def test_many_tiles_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(block_neighbours, "FAN_IN", 2)
    rows = vectors(150)
    found = block_neighbours.nearest(spark.createDataFrame(rows, SCHEMA), 20, 20, 20, 8)
    assert sorted(tuple(r) for r in found.collect()) == by_hand(rows, 20, 20, list, False)
