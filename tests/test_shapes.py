"""Structural similarities in tasks that hold the graph, against the joins that go beyond them."""

import numpy as np

from edgesmith.operators import shapes
from edgesmith.operators.graph import Graph


def _graph(spark, n=120, edges=260):
    rng = np.random.default_rng(4)
    pairs = {(min(a, b), max(a, b)) for a, b in rng.integers(-20, n, (edges, 2)).tolist() if a != b} | {(-30, x) for x in range(40)}
    return Graph(spark.createDataFrame(sorted(pairs), "u long, v long").cache())


def test_similarities_agree_with_joins(spark, monkeypatch):
    monkeypatch.setattr(shapes, "MET", 500)
    g = _graph(spark)
    got, want = shapes.landmark_similarity(g), shapes.landmark_similarity(g, most=0)
    assert "Join" not in got._jdf.queryExecution().toString()
    rows = {(r.node, r.landmark): r.sim for r in got.collect()}
    other = {(r.node, r.landmark): r.sim for r in want.collect()}
    assert rows.keys() == other.keys() and max(abs(rows[k] - other[k]) for k in rows) < 1e-8
    assert shapes.landmark_similarity(Graph(g.edges.limit(0))).count() == 0


def test_embeddings_agree_with_joins(spark):
    g = _graph(spark)
    got, want = ({r.id: np.array(r.vec) for r in shapes.structure_embedding(g, **how).collect()} for how in ({}, {"most": 0}))
    assert got.keys() == want.keys()
    ids = sorted(got)
    a, b = (np.array([x[i] for i in ids]) for x in (got, want))
    assert np.allclose(a @ a.T, b @ b.T, atol=1e-5)  # the landmarks' vectors may turn
    assert shapes.structure_embedding(Graph(g.edges.limit(0))).count() == 0


def test_factors_of_a_held_graph_agree_with_joins(spark, monkeypatch):
    from edgesmith.operators import models

    monkeypatch.setattr(models, "ENTRIES", 300)
    g = _graph(spark)
    monkeypatch.setattr(models, "cut", lambda df: (_ for _ in ()).throw(AssertionError("written")))
    for window in (1, 2, 3):
        got = {r.id: np.array(r.vec) for r in models.factor_embedding(g, 5, window).collect()}
        with monkeypatch.context() as m:
            m.setattr(models, "cut", lambda df: df.cache())
            want = {r.id: np.array(r.vec) for r in models.factor_embedding(g, 5, window, edges=0).collect()}
        assert got.keys() == want.keys()
        ids = sorted(got)
        a, b = (np.array([x[i] for i in ids]) for x in (got, want))
        assert np.allclose(a, b, atol=1e-6)
