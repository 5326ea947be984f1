"""What a task holds and looks at while it scores, encodes or prunes is bounded, whatever the rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from quarry.operators import retrieve as R


def _peak(fn) -> int:
    tracemalloc.start()
    try:
        fn()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def _brute(q, c, ids, k, cosine):
    every = np.divmod(np.arange(len(q) * len(c)), len(c))
    s = R._pair_scores(q, R._norms(q), c, R._norms(c), *every, cosine).reshape(len(q), len(c))
    return s, [sorted(range(len(c)), key=lambda j: (-s[i, j], ids[j]))[:k] for i in range(len(q))]


def test_whole_dot_products_are_not_scored_again(monkeypatch):
    rng = np.random.default_rng(0)
    q, c = (rng.integers(-3, 4, (n, 8)).astype(np.float32) for n in (30, 900))
    ids, own = rng.permutation(900), rng.integers(0, 900, 30)
    s, order = _brute(q, c, ids, 5, False)

    def fail(*_):
        raise AssertionError("exact products were scored again")

    monkeypatch.setattr(R, "_pair_scores", fail)
    scorer = R.BlockScorer(range(30), q, 5, False, s[np.arange(30), own], ids[own])
    scorer.add(ids[:400], c[:400])
    scorer.add(ids[400:], c[400:])
    for i in range(30):
        assert scorer.best_ids[i].tolist() == [ids[j] for j in order[i]]
        ahead = (s[i] > s[i, own[i]]) | ((s[i] == s[i, own[i]]) & (ids < ids[own[i]]))
        assert scorer.before[i] == ahead.sum()


@pytest.mark.parametrize("cosine", [True, False])
@pytest.mark.parametrize("size", [1e-30, 1.0, 3e7, 1e30])
def test_the_filter_loses_nothing_at_any_size(cosine, size):
    rng = np.random.default_rng(1)
    q, c = rng.normal(size=(20, 16)) * size, rng.normal(size=(600, 16)) * size
    c[300:400] = c[7] * (1 + 1e-9 * rng.normal(size=(100, 1)))      # nearer than float32 can tell
    q[3], q[4] = c[7], np.rint(q[4])
    ids = rng.permutation(600)
    s, order = _brute(q, c, ids, 5, cosine)
    scorer = R.BlockScorer(range(20), q, 5, cosine, s[:, 350], np.full(20, ids[350]))
    scorer.add(ids, c)
    for i in range(20):
        assert scorer.best_ids[i].tolist() == [ids[j] for j in order[i]]
        ahead = (s[i] > s[i, 350]) | ((s[i] == s[i, 350]) & (ids < ids[350]))
        assert scorer.before[i] == ahead.sum()


def test_a_chunk_of_ties_is_picked_in_bounded_parts():
    q, c = np.zeros((2048, 8), dtype=np.float32), np.ones((6000, 8), dtype=np.float32)
    scorer = R.BlockScorer(range(2048), q, 5, True)
    assert _peak(lambda: scorer.add(np.arange(6000), c)) < 200 << 20
    assert (scorer.best_ids == np.arange(5)).all()


def test_floats_are_not_held_as_doubles():
    q = np.random.default_rng(2).normal(size=(20000, 64)).astype(np.float32)
    assert _peak(lambda: R.BlockScorer(range(20000), q, 5, True)) < 16 << 20
    col = pa.array(list(q[:10]), pa.list_(pa.float32()))
    assert R._vectors(col, keep=True).dtype == np.float32 and R._vectors(col).dtype == np.float64


def test_a_chunk_of_scores_fits_a_cores_cache():
    rng = np.random.default_rng(3)
    q, c = (rng.normal(size=(n, 16)).astype(np.float32) for n in (2048, 4096))
    scorer = R.BlockScorer(range(2048), q, 5, True)
    scorer.add(np.arange(4096), c)
    assert _peak(lambda: scorer.add(np.arange(4096, 8192), c - 0.1)) < 12 << 20
