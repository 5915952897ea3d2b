import numpy as np
import pytest

from loomgraph.llm import topk

SCHEMA = "vec_id bigint, embedding array<float>, distance double, rank int"


def brute(rows, k):
    out = {}
    for n, (i, v) in enumerate(rows):
        far = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j is None, j) for m, (j, w) in enumerate(rows) if m != n)
        out.setdefault(i, []).extend((r + 1, j, d) for r, (d, _, j) in enumerate(far[:k]))
    return {i: sorted(v, key=str) for i, v in out.items()}


def same(got, want):
    found = {}
    for r in got.collect():
        found.setdefault(r.vec_id, []).append((r.rank, r.neighbor_id, r.distance))
    assert found.keys() == want.keys()
    for i, own in found.items():
        own = sorted(own, key=str)
        assert [x[:2] for x in own] == [x[:2] for x in want[i]]
        assert [x[2] for x in own] == pytest.approx([x[2] for x in want[i]])


@pytest.mark.parametrize("group_bytes", [topk.GROUP_BYTES, 8000])
def test_against_brute_force(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(topk, "GROUP_BYTES", group_bytes)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(8, 12)) * 3
    vec = (centres[rng.integers(0, 8, 500)] + rng.normal(size=(500, 12))).astype(np.float32)
    vec[100:140] = vec[100]  # rows alike: ties rank by id
    rows = [(int(i), v.tolist()) for i, v in enumerate(vec)]
    frame = spark.createDataFrame([(*r, 1.0, 2) for r in rows], SCHEMA).repartition(3)
    same(topk.top_k(frame, 7), brute(rows, 7))


def sides(vec, cell, pivots, asked, bound):
    n = len(vec)
    points = {"row": np.arange(n), "id": np.arange(n), "null": np.zeros(n, bool), "vec": vec, "pivot": cell, "dist": np.sqrt(((vec - pivots[cell]) ** 2).sum(1))}
    return points, {"row": np.arange(asked), "vec": vec[:asked], "bound": np.full(asked, bound)}


def test_annuli_are_passed_over(monkeypatch):
    """Far cells must not be searched: the triangle inequality is at work."""
    rng = np.random.default_rng(2)
    pivots = np.array([[0.0, 0.0], [100.0, 0.0]])
    vec = np.concatenate([rng.normal(size=(300, 2)), rng.normal(size=(300, 2)) + [100, 0]])
    cell = np.repeat([0, 1], 300)
    looked = []
    real = topk._squares
    monkeypatch.setattr(topk, "_squares", lambda a, b: looked.append(len(a.vec) * len(b.vec)) or real(a, b))
    q, p, far = topk.search_group(*sides(vec, cell, pivots, 300, 5.0), pivots, 3)
    assert p.max() < 300 and sum(looked[1:]) <= 300 * 300  # the first is of pivots
    assert len(np.unique(q)) == 300
    want = np.sort(np.sqrt(((vec[:300, None] - vec[None, :300]) ** 2).sum(2)), axis=1)[:, 1:4]
    assert far.reshape(300, 3) == pytest.approx(want)


def test_copies_are_not_searched_through(monkeypatch):
    """Of a cell of copies only the annulus of the least ids has anything to offer."""
    vec = np.zeros((5000, 3))
    pairs = []
    real = topk._exact
    monkeypatch.setattr(topk, "_exact", lambda a, b: pairs.append(len(a)) or real(a, b))
    q, p, far = topk.search_group(*sides(vec, np.zeros(5000, int), np.zeros((1, 3)), 50, np.inf), np.zeros((1, 3)), 4)
    assert not far.any() and sum(pairs) <= 50 * 300
    assert all(set(p[q == i]) == set(range(5)) - {i} if i < 5 else set(p[q == i]) == {0, 1, 2, 3} for i in range(50))


def test_stated_queries_alone_are_answered(spark):
    rng = np.random.default_rng(5)
    rows = [(i if i % 7 else None, v) for i, v in enumerate(rng.normal(size=(400, 4)).tolist())]
    frame = spark.createDataFrame([(*r, 1.0, 2) for r in rows], SCHEMA)
    got = topk.top_k(frame, 3, asks=frame.vec_id % 20 == 0)
    want = brute(rows, 3)
    same(got, {i: v for i, v in want.items() if i is not None and i % 20 == 0})


@pytest.mark.parametrize("block", [topk.BLOCK, 10])
def test_one_cell_with_most_rows(spark, monkeypatch, block):
    """Copies of one vector lie in several groups, and their queries in several blocks."""
    monkeypatch.setattr(topk, "GROUP_BYTES", 2000)
    monkeypatch.setattr(topk, "BLOCK", block)
    rng = np.random.default_rng(6)
    vec = rng.normal(size=(300, 3)).astype(np.float32)
    vec[50:250] = vec[50]
    rows = [(int(i), v.tolist()) for i, v in enumerate(vec)]
    same(topk.top_k(spark.createDataFrame([(*r, 1.0, 2) for r in rows], SCHEMA), 5), brute(rows, 5))


@pytest.mark.parametrize("size", [1e-200, 1e155, 1e200, 1e305])
def test_large_and_small_numbers(spark, size):
    rows = [(i, [float(i) ** 2 * size, 0.0]) for i in range(1, 8)]
    wide = "vec_id bigint, embedding array<double>, distance double, rank int"
    got = topk.top_k(spark.createDataFrame([(*r, 1.0, 2) for r in rows], wide), 2).collect()
    want = {(i, r + 1, j): d * size for i in range(1, 8) for r, (d, j) in enumerate(sorted((abs(float(i * i - j * j)), j) for j in range(1, 8) if j != i)[:2])}
    assert {(r.vec_id, r.rank, r.neighbor_id): r.distance for r in got} == {k: pytest.approx(v, rel=1e-12) for k, v in want.items()}


def test_numbers_of_all_sizes(spark):
    wide = "vec_id bigint, embedding array<double>, distance double, rank int"
    rows = [(1, [1e-30, 0.0]), (2, [3e-30, 0.0]), (3, [1e300, 1.0]), (4, [1e300, 0.0]), (5, [2.0, 0.0])]
    got = {r.vec_id: (r.neighbor_id, r.distance) for r in topk.top_k(spark.createDataFrame([(*r, 1.0, 2) for r in rows], wide), 1).collect()}
    assert got == {1: (2, pytest.approx(2e-30)), 2: (1, pytest.approx(2e-30)), 3: (4, 1.0), 4: (3, 1.0), 5: (1, 2.0)}


def test_odd_rows(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (None, [0.0, 1.0]), (4, [5.0, 5.0]), (4, [5.0, 5.0])]
    bad = [(10, None), (11, []), (12, [1.0]), (13, [float("nan"), 0.0]), (14, [None, 1.0]), (15, [float("inf"), 1.0])]
    frame = spark.createDataFrame([(*r, 1.0, 2) for r in rows + bad], SCHEMA)
    same(topk.top_k(frame, 3), brute(rows, 3))
    same(topk.top_k(frame, 10), brute(rows, 10))
    assert topk.top_k(frame.limit(0)).count() == 0
    assert topk.top_k(frame.where("vec_id = 1")).count() == 0
    assert topk.top_k(frame.where("embedding IS NULL")).count() == 0
