"""The best pairs of graphs in blocks, against the join of all wedges."""

import numpy as np
import pytest

from edgesmith.operators import scores, wedges
from edgesmith.operators.graph import Graph

from .test_small_graphs import GRAPHS


def _graph(seed):
    r = np.random.default_rng(seed)
    hub = [(-50, int(v)) for v in r.integers(0, 90, 30)]
    far = [(int(u), 10**12 + int(v)) for u, v in r.integers(0, 60, (60, 2))]
    pairs = [tuple(sorted(p)) for p in [*r.integers(0, 400, (900, 2)).tolist(), *r.integers(0, 40, (150, 2)).tolist(), *hub, *far]]
    return sorted({p for p in pairs if p[0] != p[1]})


@pytest.mark.parametrize("sparse", [1 << 9, 0])
@pytest.mark.parametrize("block,most,k", [(1 << 22, 1 << 28, 50), (400, 1 << 28, 300), (700, 6000, 7), (1200, 1, 10**6)])
def test_blocks_find_the_best_pairs(spark, monkeypatch, block, most, k, sparse):
    monkeypatch.setattr(wedges, "SPARSE", sparse)
    monkeypatch.setattr(wedges, "CELLS", 1 << 12)
    monkeypatch.setattr(wedges, "WEDGES", 1 << 9)
    monkeypatch.setattr(wedges, "LOT", 64)
    edges = spark.createDataFrame(_graph(block), "u long, v long")
    want = scores.top_pairs(scores.wedge_scores(Graph(edges)), "adamic_adar", k).collect()
    got = wedges.top_adamic_adar(edges.unionByName(edges.limit(40)), k, block, most).collect()
    assert [(r.u, r.v) for r in got] == [(r.u, r.v) for r in want]
    assert np.allclose([r.adamic_adar for r in got], [r.adamic_adar for r in want], rtol=0, atol=1e-9)


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_any_graph(spark, name):
    got = wedges.top_adamic_adar(spark.createDataFrame(GRAPHS[name], "u long, v long"), 100, 2).collect()
    assert len(got) == {"empty": 0, "edge": 0, "star": 21, "star and edge": 20}[name]


def test_no_wedge_is_shuffled(spark):
    from edgesmith.plans import catalogue

    plan = catalogue.QUERIES["all_adamic_adar_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Join" not in plan and "HashAggregate" not in plan
