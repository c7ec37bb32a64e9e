"""Digests of many texts at once, and walks ranked where they are made."""

import hashlib

import numpy as np

from edgesmith.functions.md5 import Prefixes
from edgesmith.operators import walkrank
from edgesmith.operators.graph import Graph


def test_digests_are_those_of_md5():
    for texts in ([b"42|7|", b"42|9|"], [b"42|123456|", b"42|654321|"], [b"42|-12345678901234567|"]):
        for end in (b"0|step", b"999|back", b""):
            want = [int(hashlib.md5(t + end).hexdigest()[:7], 16) for t in texts]
            assert Prefixes(texts).first28(end).tolist() == want


def test_ranked_walks_agree_with_joins(spark):
    rng = np.random.default_rng(2)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(-20, 130, (260, 2)).tolist() if a != b}
    g = Graph(spark.createDataFrame(sorted(pairs), "u long, v long").cache())
    nodes = g.all_nodes().unionByName(spark.createDataFrame([(None,), (999,)], "node long"))
    visits = walkrank.restart_walks(g, nodes, 8, 0.3, held=0).cache()
    assert visits.exceptAll(walkrank.restart_walks(g, nodes, 8, 0.3)).count() == 0
    want, got = walkrank.walk_candidates(g, visits, 3), walkrank.restart_candidates(g, nodes, 3, 8, 0.3)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin", "")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_sources_are_ranked_in_small_tasks(spark):
    """More tasks than cores, so that none is left alone at the end; and each source once."""
    g = Graph(spark.range(3000).selectExpr("id AS u", "id + 1 AS v"))
    out = walkrank.pagerank(g, g.all_nodes(), 2, iterations=3)
    assert out.rdd.getNumPartitions() >= 3000 // walkrank.RANKED
    got = {(r.q, r.v): r.p for r in out.collect()}
    assert len(got) == 2 * 3001 and {v for q, v in got if q == 1500} == {1497, 1503}
    assert got[1500, 1497] == got[1500, 1503]


def test_dense_ranks_are_summed_a_few_sources_at_once(monkeypatch):
    rng = np.random.default_rng(4)
    ends = np.unique(np.sort(rng.integers(0, 300, (1500, 2)), axis=1), axis=0)
    ends = ends[ends[:, 0] < ends[:, 1]]
    ends = np.unique(np.concatenate([ends, [[0, i] for i in range(1, 120)]]), axis=0)  # a hub beyond PLACES
    h = object.__new__(walkrank.Held)
    h.nodes = np.unique(ends)
    src, dst = np.searchsorted(h.nodes, np.concatenate([ends, ends[:, ::-1]]).T)
    h.to, h.deg = dst[np.lexsort((dst, src))].astype(np.int32), np.bincount(src)
    h.first = np.cumsum(h.deg) - h.deg
    widths = []
    sums = walkrank.Near.sums
    monkeypatch.setattr(walkrank, "FEW", 0)
    monkeypatch.setattr(walkrank.Near, "sums", lambda self, p, *a: widths.append(p.shape[1]) or sums(self, p, *a))
    own, step = np.arange(10), np.zeros((len(h.nodes), len(h.nodes)))
    step[src, dst] = 0.8 / h.deg[src]
    want = start = np.eye(len(h.nodes))[own]
    for _ in range(20):
        want = want @ step + 0.2 * start
    for row, (at, p) in zip(want, walkrank.Ranks(h, 0.8, 20).of(own), strict=True):
        got = np.zeros(len(h.nodes))
        got[at] = p
        assert np.allclose(got, row, rtol=0, atol=1e-13)
    assert widths and max(widths) == 4
