"""The six-node graph with values worked out by hand, and invariants of the selectors."""

import math

import pytest

from edgesmith.operators import graph as G
from edgesmith.operators import grouped, metrics, scores, search, splits, walkrank

EDGES = [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (4, 5), (5, 6)]


@pytest.fixture(scope="module")
def g(spark):
    return G.Graph(spark.createDataFrame(EDGES, "u long, v long").cache())


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_degrees_and_totals(g):
    assert rows(g.degree) == [(1, 2), (2, 3), (3, 3), (4, 3), (5, 2), (6, 1)]
    assert g.size() == (6, 7)
    assert g.totals().first()["edges_per_node"] == pytest.approx(7 / 6)


def test_canonical_drops_loops_nulls_and_repeats(spark):
    df = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (None, 1)], "u long, v long")
    assert rows(G.canonical(df)) == [(1, 2)]


def test_scores(g):
    got = {(r.u, r.v): (r.common, r.adamic_adar, r.jaccard) for r in scores.wedge_scores(g).collect()}
    assert set(got) == {(1, 4), (2, 5), (3, 5), (4, 6)}
    for pair, want in {(1, 4): (2, 1.820478, 0.666667), (2, 5): (1, 0.910239, 0.25), (3, 5): (1, 0.910239, 0.25), (4, 6): (1, 1.442695, 0.333333)}.items():
        assert got[pair] == pytest.approx(want, abs=1e-6)


def test_bfs(g):
    nodes = g.all_nodes()
    near = {}
    for q, v, _ in rows(search.bfs_candidates(g, nodes, 2)):
        near.setdefault(q, []).append(v)
    assert {q: sorted(v) for q, v in near.items()} == {1: [2, 3], 2: [1, 3], 3: [1, 2], 4: [2, 3], 5: [4, 6], 6: [4, 5]}
    far = {}
    for q, v, _ in rows(search.bfs_candidates(g, nodes, 2, exclude_edges=True)):
        far.setdefault(q, []).append(v)
    assert {q: sorted(v) for q, v in far.items()} == {1: [4, 5], 2: [5, 6], 3: [5, 6], 4: [1, 6], 5: [2, 3], 6: [2, 4]}


def test_layers(g, spark):
    one = spark.createDataFrame([(1,)], "node long")
    assert rows(search.layers(g, one, 2)) == [(1, 1, 0), (1, 2, 1), (1, 3, 1), (1, 4, 2)]


def test_truncated_pagerank(g):
    w = walkrank.TruncatedPageRank(g, 4, keep=20)
    pi = w.state()
    assert [round(x, 6) for x in w.ratios] == pytest.approx([1.2, 0.853333, 0.591012, 0.410653, 0.284529, 0.194061, 0.133609, 0.091698, 0.063291], abs=2e-6)
    got = {(r.q, r.v): r.p for r in pi.collect()}
    want = {(1, 1): 0.320803, (1, 4): 0.140848, (2, 5): 0.066994, (4, 6): 0.050869, (5, 2): 0.100492, (6, 5): 0.317321, (6, 6): 0.312518, (6, 1): 0.040090}
    for pair, p in want.items():
        assert got[pair] == pytest.approx(p, abs=1e-6)
    mass = {}
    for (q, _), p in got.items():
        mass[q] = mass.get(q, 0) + p
    assert max(mass.values()) <= 1 + 1e-9
    assert rows(w.candidates(pi)) == [(1, 4), (2, 5), (3, 5), (4, 6)]


def test_pagerank_and_restart_walks_emit_no_neighbours(g):
    edges = set(EDGES) | {(b, a) for a, b in EDGES}
    for df in (walkrank.pagerank(g, g.all_nodes(), 3), walkrank.walk_candidates(g, walkrank.restart_walks(g, g.all_nodes(), 20), 3)):
        for q, v, _ in rows(df):
            assert q != v and (q, v) not in edges
    assert sum(r.visits for r in walkrank.restart_walks(g, g.all_nodes(), 20).collect()) == 6 * 20


def test_walks_by_joins_and_in_tasks_agree(g):
    nodes = g.all_nodes()
    for steps in (1, 7):
        assert rows(walkrank.restart_walks(g, nodes, steps, 0.3)) == rows(walkrank.restart_walks(g, nodes, steps, 0.3, held=0))
    for iterations in (1, 4):
        one, two = (rows(walkrank.pagerank(g, nodes, 3, iterations=iterations, held=held)) for held in (1000, 0))
        assert [r[:2] for r in one] == [r[:2] for r in two] and [r[2] for r in one] == pytest.approx([r[2] for r in two], abs=1e-9)


def test_metrics(spark):
    predicted = spark.createDataFrame([(1, 4), (2, 5), (3, 5), (4, 6)], "u long, v long")
    hidden = spark.createDataFrame([(1, 4), (1, 6)], "u long, v long")
    m = metrics.benchmark_metrics(predicted, hidden, 6).first()
    assert (m.n_found, m.recall, m.precision, m.scans_per_found_edge) == (1, 0.5, 0.25, 4.0)
    assert m.scan_rate == pytest.approx(4 / 36)
    none = metrics.benchmark_metrics(predicted.limit(0), hidden.limit(0), 6).first()
    assert (none.recall, none.precision, none.scans_per_found_edge) == (0.0, 0.0, 0.0)


def test_degree_groups_of_a_small_graph_are_one_cell(g):
    assert {r.bin for r in G.degree_bins(g.degree).collect()} == {24}
    cell = grouped.cells(g, grouped.degree_groups(g), 4).collect()
    assert [(c.n, c.p, c.kappa, c.sigma) for c in cell] == [(7, 1.0, 4, 0)]
    assert rows(grouped.select(g, grouped.degree_groups(g), 4)) == [(1, 4), (2, 5), (3, 5), (4, 6)]


def test_file_order_split_counts_repeats(spark):
    order = [("a", "b"), ("b", "c"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "a")]
    df = spark.createDataFrame([(i + 1, *p) for i, p in enumerate(order)], "rn long, u string, v string")
    got = {(r.u, r.v): r.part for r in splits.file_order_split(df).collect()}
    assert got == {("a", "b"): "rest", ("b", "c"): "rest", ("c", "d"): "train", ("d", "e"): "test", ("a", "e"): "test"}


def test_splits_are_disjoint_and_whole(g):
    got = splits.static_split(g.edges).groupBy("part").count().collect()
    assert {r.part: r["count"] for r in got} == {"rest": 4, "train": 1, "valid": 1, "test": 1}


def test_negatives_are_no_edges(g):
    got = rows(splits.negatives(g.edges, 6, 5, spare=20))
    assert len(got) == len(set(got)) == 5
    assert not set(got) & set(EDGES) and all(u < v for u, v in got)


def test_hard_average_precision(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (0, 0), (0, 0)], "y long, yhat long")
    assert metrics.hard_average_precision(df).first()[0] == pytest.approx(0.45)


def test_run_analytics(spark):
    r = spark.createDataFrame([("D1", "A", 1, 0.2, 1.04, 1), ("D1", "A", 10, 0.6, 2.0, 2), ("D1", "B", 1, 0.4, 3.0, 3), ("D1", "A", 1, 0.3, 9.0, 4)], "dataset string, method string, h int, recall double, time double, seq long")
    assert metrics.time_table(r, ["A", "B"]).first().asDict() == {"dataset": "D1", "A_h1": "1.0", "A_h10": "2.0", "B_h1": "3.0", "B_h10": "XX"}
    assert {x.method: x.avg_recall for x in metrics.average_recall(r).collect()} == {"A": 0.08, "B": 0.04}
    best = metrics.best_methods(r).first()
    assert (best.best, best.gap) == ("A", 0.5)
    assert {(x.method, x.x): x.y for x in metrics.mean_by(r, "h", "recall").collect()}["A", 1] == pytest.approx(0.25)


def test_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, i, k + 1) for k, i in enumerate([10, 11, 12])], "user long, item long, rk long")
    m = metrics.ranking_metrics(ranked, spark.createDataFrame([(1, 11), (1, 13)], "user long, item long"), 3).first()
    assert m.recall == 0.5 and m.rr == 0.5 and m.ap == 0.25
    assert m.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def _brute(g, iterations):
    """Untruncated personalised PageRank of every source by dense sums."""
    near = {}
    for r in g.adj.collect():
        near.setdefault(r.src, []).append(r.dst)
    out = {}
    for q in near:
        p = {q: 1.0}
        for _ in range(iterations):
            new = {q: 0.2}
            for x, mass in p.items():
                for y in near[x]:
                    new[y] = new.get(y, 0) + 0.8 * mass / len(near[x])
            p = new
        out |= {(q, v): x for v, x in p.items() if v != q and v not in near[q]}
    return out


def test_full_selectors_are_registered_with_defaults_and_no_sql():
    from edgesmith.plans import catalogue

    for name in "walk_candidates ppr_topk restart_visits restart_topk knn_simple knn_descent hash_codes hash_pairs".split():
        assert f"{name}_full" in catalogue.QUERIES and f"{name}_full" not in catalogue.SQL


def test_walks_by_default_settle_as_brute_force_has_it(spark, monkeypatch):
    from edgesmith.plans import graph_queries as Q

    path = G.Graph(spark.createDataFrame([(i, i + 1) for i in range(1, 8)] + [(2, 5)], "u long, v long"))
    monkeypatch.setattr(Q.V, "part_graph", lambda spark, sf: path)
    got, want = {(r.q, r.v): r.p for r in Q.ppr_topk_full(spark, "").collect()}, _brute(path, 20)
    assert got == {k: pytest.approx(x, abs=1e-8) for k, x in want.items()}
    short = {(r.q, r.v): r.p for r in Q.ppr_topk(spark, "").collect()}
    assert short == {k: pytest.approx(x, abs=1e-8) for k, x in _brute(path, 3).items()} and len(short) < len(got)
    w = walkrank.TruncatedPageRank(path, 8)
    w.state()
    assert len(w.ratios) >= 3 and (w.ratios[-1] < w.epsilon or len(w.ratios) == w.max_iterations)
    assert {tuple(r) for r in Q.walk_candidates_full(spark, "").collect()} == {tuple(r) for r in w.candidates(w.state(len(w.ratios))).collect()}
