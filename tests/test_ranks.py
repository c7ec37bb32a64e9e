"""Walks over a held graph: by lists, by sums over what is near, and by the matrix."""

import numpy as np
import pytest

from edgesmith.operators import walkrank


def _held(n=150, edges=400, seed=5):
    rng = np.random.default_rng(seed)
    a, b = np.append(rng.integers(1, n, edges), np.zeros(n - 1, int)), np.append(rng.integers(1, n, edges), np.arange(1, n))  # 0 is a hub of all
    pairs = {(min(x), max(x)) for x in zip(a.tolist(), b.tolist(), strict=True) if x[0] != x[1]}
    w = np.zeros((n, n))
    for u, v in pairs:
        w[u, v] = w[v, u] = 1
    h = walkrank.Held.__new__(walkrank.Held)
    h.nodes, h.deg = np.arange(n), w.sum(1).astype(np.int64)
    h.to, h.first = np.nonzero(w)[1].astype(np.int32), np.cumsum(h.deg) - h.deg
    return h, w


@pytest.mark.parametrize("few", [0, 1 << 30])
def test_ranks_are_those_of_the_matrix(monkeypatch, few):
    h, w = _held()
    monkeypatch.setattr(walkrank, "FEW", few)
    monkeypatch.setattr(walkrank, "DENSE", 1 << 20)
    assert h.deg.max() > walkrank.PLACES
    own = np.array([3, 0, 77])
    for iterations in (0, 1, 3, 20):
        p = np.eye(150)[:, own]
        for _ in range(iterations):
            p = 0.8 * (w / h.deg) @ p + 0.2 * np.eye(150)[:, own]
        for r, (at, got) in enumerate(walkrank.Ranks(h, 0.8, iterations).of(own)):
            made = np.zeros(150)
            made[at] = got
            assert np.allclose(made, p[:, r], atol=1e-14)
    assert list(walkrank.Ranks(h, 0.8, 3).of(np.zeros(0, np.int64))) == []
