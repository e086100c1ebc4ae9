import numpy as np
import pytest

from lumenloom.operators.similarity import Cells, SimilarityJoin, greedy_filter

SMALL = Cells(pivots=9, rows=8, block=16)


def vectors(seed, n, dims=12, clusters=5, spread=0.25):
    r = np.random.RandomState(seed)
    centres = r.randn(clusters, dims)
    v = centres[r.randint(clusters, size=n)] + spread * r.randn(n, dims)
    v[::7] = r.randn(len(v[::7]), dims)
    v[3::11] = v[3]
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def frame(spark, v, start=0):
    return spark.createDataFrame([(start + i, i, x.tolist()) for i, x in enumerate(v)], "id long, n long, embedding array<double>")


@pytest.mark.parametrize("threshold", [0.5, 0.95])
def test_pairs_and_best(spark, threshold):
    a, b = vectors(1, 90), vectors(2, 150)
    b[10:20] = a[:10]
    join = SimilarityJoin(frame(spark, a), frame(spark, b, 1000), threshold, SMALL)
    s = np.round(a @ b.T, 9)
    want = {(i, 1000 + j) for i, j in zip(*np.nonzero(s > threshold))}
    assert {(r.id, r.match) for r in join.pairs().collect()} == want and len(want) > 20
    best = {i: 1000 + int(row.argmax()) for i, row in enumerate(s) if row.max() > threshold}
    assert {r.id: r.match for r in join.best().collect()} == best
    done, all_ = join.compared()
    assert all_ == 90 * 150 and done >= len(want)
    if threshold > 0.9:
        assert done < 0.65 * all_  # cells are tight: many pairs are not looked at


def plain_greedy(v, threshold):
    kept, out = [], {}
    for i in range(len(v)):
        s = [round(float(v[i] @ v[k]), 9) for k in kept]
        if s and max(s) > threshold:
            out[i] = kept[int(np.argmax(s))]
        else:
            kept.append(i)
            out[i] = None
    return out


@pytest.mark.parametrize("threshold", [0.4, 0.9])
def test_greedy_filter(spark, threshold):
    v = vectors(3, 160)
    got = {r.id: r.duplicate_of for r in greedy_filter(frame(spark, v), threshold, SMALL).collect()}
    assert got == plain_greedy(v, threshold)


def test_a_chain_of_neighbours(spark):
    """Each is like the next only: every second one stays."""
    angles = np.arange(8) * 0.3
    v = np.stack([np.cos(angles), np.sin(angles)], axis=1)
    got = {r.id: r.duplicate_of for r in greedy_filter(frame(spark, v), float(np.cos(0.31)), SMALL).collect()}
    assert got == {0: None, 1: 0, 2: None, 3: 2, 4: None, 5: 4, 6: None, 7: 6}


def test_a_large_group_gives_no_pairs(spark):
    """A group of near-copies: rows of a task are at most one for each vector and part."""
    r = np.random.RandomState(5)
    v = r.randn(8) + 0.01 * r.randn(300, 8)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    join = SimilarityJoin(frame(spark, v), frame(spark, v), 0.9, Cells(pivots=4, block=64))
    parts = int(sum(-(-c // 64) for c in join.members))
    assert join._found("first before").count() <= 300 * parts
    got = {x.id: x.duplicate_of for x in greedy_filter(frame(spark, v), 0.9, SMALL).collect()}
    assert got == {i: 0 if i else None for i in range(300)}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "id long, n long, embedding array<double>")
    some = spark.createDataFrame([(1, 0, [1.0, 0.0]), (2, 1, None), (3, 2, [0.0, 0.0]), (4, 3, [1.0, 0.0])], "id long, n long, embedding array<double>")
    for a, b in ((empty, some), (some, empty), (empty, empty)):
        join = SimilarityJoin(a, b, 0.5)
        assert join.pairs().collect() == join.best().collect() == []
    assert {tuple(r) for r in SimilarityJoin(some, some, 0.5).pairs().select("id", "match").collect()} == {(1, 1), (1, 4), (4, 1), (4, 4)}
    assert greedy_filter(empty, 0.5).collect() == []
    assert {r.id: r.duplicate_of for r in greedy_filter(some, 0.5).collect()} == {1: None, 3: None, 4: 1}


@pytest.mark.parametrize("mode", ["all", "best", "first before", "best before"])
def test_parts_are_compared_by_squares(mode):
    """As with the whole matrix of scores; the memory is that of one square."""
    import tracemalloc

    import pyarrow as pa

    from lumenloom.operators.similarity import _pick

    random = np.random.RandomState(4)
    v = random.randn(2600, 16)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[1300:1310] = v[:10]  # equal ones tie
    order = random.permutation(2600)
    side = lambda rows: pa.table({"id": pa.array(rows), "n": pa.array(order[rows]), "embedding": pa.array(v[rows].tolist(), pa.list_(pa.float64()))})
    left, right = np.arange(0, 2600), np.arange(100, 2600)
    tracemalloc.start()
    got = _pick(mode, 0.6, side(left), side(right)).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    right = right[np.argsort(order[right])]
    scores = np.round(v[left] @ v[right].T, 9)
    if "before" in mode:
        scores[order[right][None, :] >= order[left][:, None]] = -np.inf
    over = scores > 0.6
    want = {(int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(over))} if mode == "all" else {(int(left[i]), int(right[(over[i] if mode == "first before" else scores[i]).argmax()])) for i in np.flatnonzero(over.any(axis=1))}
    assert set(zip(got["id"], got["match"])) == want and len(got["id"]) == len(want) and want
    assert all(m == order[x] and s > 0.6 for m, x, s in zip(got["m"], got["match"], got["similarity"]))
    assert peak < 40e6
