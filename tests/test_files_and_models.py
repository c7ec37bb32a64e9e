"""Readers, writers, vectors and models."""

import numpy as np
import pytest

from edgesmith.operators import graph as G
from edgesmith.operators import grouped, knn, lsh, models, search
from edgesmith.sources import files


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_edge_readers(spark):
    text = lines(spark, "# note", "b a", "a  b", "c\tc", "b c", "")
    assert rows(files.edges(spark, text)) == [("a", "b"), ("b", "c")]
    assert files.is_temporal(spark, text) is False
    assert files.is_temporal(spark, lines(spark, "# x", "a b 1")) is True
    assert files.is_temporal(spark, text.limit(0)) is None
    assert rows(files.two_sided_edges(spark, lines(spark, "u1 m1", "u1 m1"))) == [("u1", "m1", 0, 1)]
    assert rows(files.weighted_edges(spark, lines(spark, "1 2 0.5"))) == [(1, 2, 0.5)]
    assert rows(files.adjacency_lists(spark, lines(spark, "1 2 3", "2 1", "4"))) == [(1, 2), (1, 3)]
    assert rows(files.clique(spark, 3)) == [(1, 2), (1, 3), (2, 3)]
    assert [r.rn for r in files.quote_edges(spark, lines(spark, "% c", "a\tb\t1\t5", "b\tc\t1\t4")).orderBy("ts").collect()] == [1, 2]


def test_vectors_walks_ratings_round_trip(spark):
    emb = spark.createDataFrame([("a", [1.0, -0.5]), ("b", [0.0, 2.0])], "id string, vec array<double>")
    assert rows(files.vectors(spark, files.vector_lines(emb).union(lines(spark, "2 2")))) == [("a", [1.0, -0.5]), ("b", [0.0, 2.0])]
    assert [r[0] for r in files.walk_lines(files.walks(spark, lines(spark, "1 2 1"))).collect()] == ["1 2 1"]
    r = files.ratings(spark, lines(spark, "1\t7\t3", "1\t8\t4", "1\t9\t5"))
    assert [x.part for x in files.split_ratings(r).orderBy("part").collect()] == ["test", "test", "train"]


def test_numbering_and_pair_files(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "c"), ("b", "c")], "u string, v string")
    numbered, names = files.number_nodes(pairs)
    assert rows(names) == [("a", 0), ("b", 1), ("c", 2)] and rows(numbered) == [(0, 2), (1, 2)]
    files.write_pairs(numbered, str(tmp_path / "p"))
    assert rows(spark.read.csv(str(tmp_path / "p"), schema="u long, v long")) == [(0, 2), (1, 2)]


def clustered(spark, n=40, seed=1):
    r = np.random.default_rng(seed)
    v = np.concatenate([r.normal(0, 0.1, (n // 2, 4)) + [1, 0, 0, 0], r.normal(0, 0.1, (n // 2, 4)) + [0, 1, 0, 0]])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")


def test_neighbour_searches_find_the_neighbours(spark):
    v, emb = clustered(spark)
    sims = np.round(v @ v.T, 9)
    every = {(r.u, r.v): r.score for r in knn.exhaustive(emb).collect()}
    assert len(every) == 40 * 39 // 2 and all(abs(sims[p] - s) < 1e-8 for p, s in every.items())
    np.fill_diagonal(sims, -9)
    best = {i: set(np.argsort(-sims[i])[:3]) for i in range(40)}
    for found in (knn.simple(emb, 3, 15), knn.descent(emb, 3, 15, sample_rate=1.0, reverse=True)):
        got = [(r.v, r.u) for r in found.collect()]
        assert sum(u in best[q] for q, u in got) / 120 > 0.7


def test_hash_pairs_hold_what_shares_a_leaf(spark):
    _, emb = clustered(spark)
    leaves = lsh.codes(emb, 2, 3, 4)
    by = {}
    for r in leaves.collect():
        by.setdefault((r.tree, r.leaf), []).append(r.id)
    want = {(a, b) for ids in by.values() for a in ids for b in ids if a < b}
    assert {(r.u, r.v) for r in lsh.pairs(emb, leaves).collect()} == want


def test_cell_pairs_are_all_pairs_of_the_cell(spark):
    _, emb = clustered(spark, 12)
    groups = spark.createDataFrame([(i, i % 2) for i in range(12)], "node long, grp int")
    wanted = spark.createDataFrame([(0, 1)], "g1 int, g2 int")
    got = {(r.u, r.v) for r in grouped.vector_pairs(emb, groups, wanted).collect()}
    assert got == {(a, b) for a in range(12) for b in range(a + 1, 12) if a % 2 != b % 2}


def test_link_model_learns(spark):
    v, emb = clustered(spark)
    pairs = spark.createDataFrame([(i, j, int((i < 20) == (j < 20))) for i in range(40) for j in range(i + 1, 40)], "u long, v long, y int")
    f = models.pair_features(pairs, emb)
    model, score = models.fit_links(f, f, (0.1, 1.0), 50)
    assert score > 0.9
    p = {(r.u, r.v): r.p for r in models.link_probability(model, pairs.select("u", "v"), emb).collect()}
    assert p[0, 1] > p[0, 39]


def ring(spark, n=30):
    return G.Graph(spark.createDataFrame(sorted({tuple(sorted((i, (i + k) % n))) for i in range(n) for k in (1, 2)}), "u long, v long").cache())


def test_embeddings_have_a_row_a_node(spark):
    g = ring(spark)
    f = models.structure_features(g, search.layers(g, g.all_nodes(), 2)).cache()
    marks = [0, 5, 9]
    sim = models.landmark_similarity(f, spark.createDataFrame([(m,) for m in marks], "node long"))
    assert {r.sim for r in sim.collect()} == {1.0}  # a ring looks alike from everywhere
    assert models.structure_embedding(sim, marks).count() == 30
    assert models.factor_embedding(g, 4).count() == 30


def test_skipgram_loss_falls(spark):
    g = G.Graph(spark.createDataFrame([(2 * i, 2 * j + 1) for i in range(6) for j in range(6) if (i + j) % 2], "a long, b long").selectExpr("least(a,b) u", "greatest(a,b) v").cache())
    counts = models.walk_counts(models.side_scaled(models.hits(g, 3)))
    walks = models.walk_corpus(g, counts, 3).cache()
    assert {(r.node - r.at) % 2 for r in walks.collect()} == {0}  # walks stay on their side
    _, losses = models.skipgram_embedding(g, walks, 4, 4)
    assert losses[-1] < losses[0]


def test_skipgram_in_tasks_agrees_with_joins(spark, monkeypatch):
    g = G.Graph(spark.createDataFrame([(2 * i, 2 * j + 1) for i in range(9) for j in range(9) if (i * j) % 3], "a long, b long").selectExpr("least(a,b) u", "greatest(a,b) v").cache())
    walks = models.walk_corpus(g, g.all_nodes().selectExpr("node", "3 AS walks"), 3).cache()
    want, losses = models.skipgram_embedding(g, walks, 4, 3, reach=2, held=0)
    monkeypatch.setattr(models, "PAIRS", 40)
    got, same = models.skipgram_embedding(g, walks, 4, 3, reach=2)
    assert same == pytest.approx(losses, rel=1e-9) and "Join" not in got._jdf.queryExecution().toString()
    want = {r.id: r.vec for r in want.collect()}
    assert {r.id: r.vec for r in got.collect()} == {k: pytest.approx(x, abs=1e-9) for k, x in want.items()} and len(want) > 9


def test_factor_ensemble(spark):
    g = ring(spark)
    got = models.nmf_ensemble(g, 10, bags=2, share=0.5, epsilon=0.01).collect()
    assert 0 < len(got) <= 10 and all(r.u < r.v for r in got)
    assert not {(r.u, r.v) for r in got} & {(r.u, r.v) for r in g.edges.collect()}
    f = spark.createDataFrame([(1, 0, 0.9), (2, 0, 0.8), (3, 0, 0.1), (1, 1, 0.5), (2, 1, 0.5)], "node long, c int, f double")
    assert [tuple(r) for r in models.factor_pairs(f, 0.4).collect()] == [(1, 2, 0.97)]
