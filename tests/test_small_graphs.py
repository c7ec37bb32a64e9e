"""Graphs without edges, with one edge, and stars, under joins that sort and merge."""

import pytest

from edgesmith.operators import graph as G
from edgesmith.operators import grouped, models, scores, walkrank

GRAPHS = {"empty": [], "edge": [(1, 2)], "star": [(1, i) for i in range(2, 9)], "star and edge": [(1, i) for i in range(2, 9)] + [(2, 3)]}


@pytest.fixture(params=["broadcast", "merge"])
def joins(request, spark):
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"} if request.param == "merge" else {}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("name", sorted(GRAPHS))
def test_selectors_take_any_graph(spark, joins, name):
    edges = GRAPHS[name]
    g = G.Graph(spark.createDataFrame(edges, "u long, v long"))
    n = len({x for e in edges for x in e})
    assert g.size() == (n, len(edges))
    found = {(r.u, r.v) for r in scores.wedge_scores(g).collect()}
    assert len(found) == {"empty": 0, "edge": 0, "star": 21, "star and edge": 20}[name]
    for bailout in (None, 0.5):
        got = {(r.u, r.v) for r in grouped.select(g, grouped.degree_groups(g), 5, bailout=bailout).collect()}
        assert got <= found and len(got) == min(5, len(found))
    assert walkrank.TruncatedPageRank(g, 4).run().count() <= 4
    assert models.degree_centrality(g).count() == n
