"""Truncated PageRank in blocks, against its joins."""

import numpy as np
import pytest

from edgesmith.operators import walkblocks, walkrank
from edgesmith.operators.graph import Graph

from .test_small_graphs import GRAPHS


def _graph(seed, two_sided=False):
    r = np.random.default_rng(seed)
    hub = [(-50, int(v)) for v in r.integers(0, 90, 30)]
    far = [(int(u), 10**12 + int(v)) for u, v in r.integers(0, 60, (60, 2))]
    pairs = [tuple(sorted(p)) for p in [*r.integers(0, 200, (400, 2)).tolist(), *r.integers(0, 40, (150, 2)).tolist(), *hub, *far]]
    return sorted({p for p in pairs if p[0] != p[1] and (not two_sided or (p[0] - p[1]) % 2)})


@pytest.mark.parametrize("block,keep,budget,two_sided,sparse", [(900, 5, None, False, 1 << 9), (400, 4, None, True, 0)])
def test_blocks_give_the_candidates_of_joins(spark, monkeypatch, block, keep, budget, two_sided, sparse):
    for name, x in {"BLOCK": block, "MOST": 2 * block, "PASS": 16 * block, "ROW": 50, "TERMS": 1 << 9, "CELLS": 1 << 12, "SPARSE": sparse, "BUCKETS": 8}.items():
        monkeypatch.setattr(walkblocks, name, x)
    edges = spark.createDataFrame(_graph(block, two_sided), "u long, v long").cache()
    w = walkrank.TruncatedPageRank(Graph(edges), budget or edges.count(), keep=keep, bipartite=two_sided)
    want = sorted(map(tuple, w.candidates(w.state()).collect()))
    got, ratios = walkblocks.walk(edges.unionByName(edges.limit(40)), budget, keep=keep, bipartite=two_sided)
    assert ratios == pytest.approx(w.ratios, abs=1e-9)
    assert sorted(map(tuple, got.collect())) == want != []


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_any_graph(spark, name):
    edges = spark.createDataFrame(GRAPHS[name], "u long, v long")
    w = walkrank.TruncatedPageRank(Graph(edges), 4)
    assert sorted(map(tuple, w.run().collect())) == sorted(map(tuple, w.candidates(w.state()).collect()))


def test_names_go_by_joins(spark):
    named = Graph(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "u string, v string"))
    assert {tuple(r) for r in walkrank.TruncatedPageRank(named, 3).run().collect()} <= {("a", "c"), ("b", "d"), ("a", "d")}


def test_arrays_come_back(spark):
    r = np.random.default_rng(5)
    some = [np.zeros(0, np.int64), r.integers(-(2**62), 2**62, 9), r.integers(7, 200, 300), r.random(11), np.array([-5, 70000]), np.zeros(0)]
    for a, b in zip(some, walkblocks._unpack(walkblocks._pack(*some)), strict=True):
        assert a.dtype.kind == b.dtype.kind and a.tolist() == b.tolist()


@pytest.mark.parametrize("name", ["walk_candidates_bipartite", "walk_candidates_full"])
def test_no_term_is_shuffled(spark, name):
    from edgesmith.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "Aggregate" not in plan and "Window" not in plan
