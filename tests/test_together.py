"""Series that are worked on together come out as one by one, and in fewer steps."""

import numpy as np
import pytest

from tessera.functions import hmm


def _model(rng, k=4):
    with np.errstate(divide="ignore"):
        start, trans = np.log(np.eye(k)[0]), np.log(rng.dirichlet(np.ones(k), k))
    return hmm.Hmm(rng.normal(size=(k, 2)), rng.uniform(0.5, 2, (k, 2)), trans, start, np.full(k, -1.0))


def _one(m, x):
    """Log chances by plain sums over the trellis: of each frame's states, of moves, and of all paths; and the best path."""
    e, n, k = m.emit(x), len(x), len(m.start)
    a, b, v, back = np.zeros((n, k)), np.zeros((n, k)), m.start + e[0], np.zeros((n, k), int)
    a[0] = m.start + e[0]
    for t in range(1, n):
        a[t] = np.logaddexp.reduce(a[t - 1][:, None] + m.trans, axis=0) + e[t]
        back[t], v = (v[:, None] + m.trans).argmax(0), (v[:, None] + m.trans).max(0) + e[t]
    for t in range(n - 2, -1, -1):
        b[t] = np.logaddexp.reduce(m.trans + (e[t + 1] + b[t + 1])[None], axis=1)
    total = np.logaddexp.reduce(a[-1])
    moves = sum((np.exp(a[t][:, None] + m.trans + (e[t + 1] + b[t + 1])[None] - total) for t in range(n - 1)), np.zeros((k, k)))
    path = [int(v.argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t, path[-1]]))
    return np.exp(a + b - total), moves, total, path[::-1], v.max()


@pytest.mark.parametrize("held", [1, 1 << 21])
def test_together(monkeypatch, held):
    monkeypatch.setattr(hmm, "HELD", held)
    rng = np.random.default_rng(5)
    m, xs = _model(rng), [rng.normal(size=(n, 2)) for n in (7, 1, 12, 7, 30, 2, 3)]
    paths, lls = hmm.viterbi_many(m, xs)
    for x, (p, moves, total), f, path, ll in zip(xs, hmm.forward_backward_many(m, xs), hmm.forward_many(m, xs), paths, lls):
        want = _one(m, x)
        assert np.allclose(p, want[0]) and np.allclose(moves, want[1]) and total == pytest.approx(want[2]) == pytest.approx(f)
        assert path.tolist() == want[3] and ll == want[4]


def test_blocks_together():
    """Blocks of different lengths, of which some begin a series: products, and paths within them, as one at a time."""
    rng = np.random.default_rng(6)
    m, xs = _model(rng, 5), [rng.normal(size=(n, 2)) for n in (6, 9, 6, 2, 9, 1)]
    first = [True, False, False, True, False, False]
    for x, f, got in zip(xs, first, hmm.block_products(m, xs, first)):
        assert np.array_equal(got, hmm.block_products(m, [x], [f])[0])
    before = [np.zeros(0) if f else rng.normal(size=5) for f in first]
    for x, b, got in zip(xs, before, hmm.viterbi_within_many(m, xs, before, [4] * 6)):
        assert got.tolist() == hmm.viterbi_within(m, x, b, 4).tolist()


def test_few_steps(monkeypatch):
    """Chances of frames are computed for many series at a time, whatever their lengths."""
    rng, calls = np.random.default_rng(7), []
    m, emit = _model(rng), hmm.Hmm.emit
    monkeypatch.setattr(hmm.Hmm, "emit", lambda self, x: calls.append(len(x)) or emit(self, x))
    xs = [rng.normal(size=(n, 2)) for n in range(1, 200)]
    hmm.forward_backward_many(m, xs)
    hmm.block_products(m, xs, [True] * len(xs))
    assert len(calls) == 2
