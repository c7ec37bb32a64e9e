"""Grouped search, forests, bags, walks and recommendation on small graphs, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgesmith import __main__ as cli
from edgesmith.operators import graph as G
from edgesmith.operators import grouped, knn, lsh, metrics, models, sampling, splits
from edgesmith.plans import harness as H
from edgesmith.sources import files


@pytest.fixture(scope="module")
def edges():
    r = random.Random(4)
    return sorted({tuple(sorted((i, (i + r.randrange(1, 6)) % 40))) for i in range(40) for _ in range(3)})


@pytest.fixture(scope="module")
def g(spark, edges):
    return G.Graph(spark.createDataFrame(edges, "u long, v long").cache())


@pytest.fixture(scope="module")
def emb(spark):
    r = np.random.default_rng(3)
    return spark.createDataFrame([(i, [float(x) for x in r.normal(size=8) + np.eye(8)[i % 4] * 3]) for i in range(40)], "id long, vec array<double>").cache()


def pairs(df):
    return [(r.u, r.v) for r in df.collect()]


def test_small_cells_give_all_their_pairs(spark, g, edges):
    """Nodes 0 and 1 are a group of their own: with a large budget their cells are no larger than what they may take."""
    groups = spark.createDataFrame([(i, 0 if i < 2 else 1) for i in range(40)], "node long, grp long")
    got = pairs(grouped.select(g, groups, 5000))
    known = set(edges)
    cell = {(r.g1, r.g2): r for r in grouped.cells(g, groups, 5000).collect()}
    for (a, b), r in cell.items():
        every = {(u, v) for u in range(40) for v in range(u + 1, 40) if {u < 2, v < 2} == {a == 0, b == 0} and (u < 2) + (v < 2) == (a == 0) + (b == 0)} - known
        if r.kappa - r.sigma >= r["size"]:
            assert every <= set(got)
    assert any(r.kappa - r.sigma >= r["size"] for r in cell.values()) and len(got) == len(set(got)) and not set(got) & known


def test_exact_and_tree_search_of_cells(spark, g, edges, emb):
    groups = spark.createDataFrame([(i, i % 4) for i in range(40)], "node long, grp long")
    exact = grouped.close_pairs(g, groups, 60, emb).collect()
    trees = {(r.u, r.v): r.score for r in grouped.close_pairs(g, groups, 60, emb, tolerance=0).collect()}
    assert trees and not set(trees) & set(edges)
    best = {(r.u, r.v): r.score for r in exact}
    shared = set(trees) & set(best)
    assert len(shared) >= 0.7 * len(best) and all(trees[p] == best[p] for p in shared)
    assert len(pairs(grouped.select(g, groups, 60, grouped.close_pairs(g, groups, 60, emb), 0.5))) == 60


def test_trees_are_split_until_few_pairs_share_a_leaf(spark, emb):
    leaves = lsh.codes(emb, 3, 8, 8).withColumn("grp", F.lit(0)).cache()
    cells = spark.createDataFrame([(0, 0, 10, 8, 3)], "g1 int, g2 int, kappa int, depth int, trees int")
    rows = leaves.collect()
    volume = lambda t, d: sum(n * (n - 1) // 2 for n in __import__("collections").Counter(r.leaf[:d] for r in rows if r.tree == t).values())
    for r in lsh.tree_depths(leaves, cells, floor=60).collect():
        stop = next((d for d in range(9) if volume(r.tree, d) <= 60), 8)
        assert r.d == (stop - 1 if stop and volume(r.tree, stop) < 10 else stop)


@pytest.mark.parametrize("mode", sampling.MODES)
def test_bags_grow_by_neighbourhoods(g, edges, mode):
    got = sampling.bags(g, 2, 0.4, mode=mode, steps=5).collect()
    near = {n: {n} | {x for e in edges if n in e for x in e} for e in edges for n in e}
    for bag in (0, 1):
        mine = {r.node for r in got if r.bag == bag}
        assert len(mine) >= 16 and all(near[n] & mine for n in mine)
    assert {r.node for r in got if r.bag == 0} != {r.node for r in got if r.bag == 1}


def test_walks_go_along_edges_and_biased_ones_spread(g, edges):
    known = set(edges)
    plain, spread = sampling.walk(g, 12), sampling.walk(g, 12, biased=True)
    for path in (plain, spread):
        assert len(path) == 13 and all(tuple(sorted(e)) in known for e in zip(path, path[1:]))
    used, near = {}, {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for at, to in zip(spread, spread[1:]):
        used[at] = used.get(at, 0) + 1
        assert used.get(to, 0) == min(used.get(x, 0) for x in near[at])
    assert set(pairs(sampling.walk_subgraph(g, 12))) == {tuple(sorted(e)) for e in zip(plain, plain[1:])}


def test_factors_fit_their_bag_without_a_square(spark, g, edges):
    bag = g.edges.select(F.lit(0).alias("bag"), "u", "v")
    f = models.symmetric_nmf(bag, rank=10, iterations=200)
    w, x = np.zeros((40, 40)), np.zeros((40, 10))
    for u, v in edges:
        w[u, v] = w[v, u] = 1
    for r in f.collect():
        x[r.node, r.c] = r.f
    error = np.linalg.norm(w - x @ x.T)
    assert models.factor_error(bag, f).first().error == pytest.approx(error, abs=1e-6) and error < 0.8 * np.linalg.norm(w)
    assert models.filter_bags(bag, 0.5).count() == len(edges) // 2
    ranks = models.sorted_columns(f).collect()
    assert all(a.f >= b.f for a in ranks for b in ranks if a.c == b.c and b.rk == a.rk + 1)


@pytest.mark.parametrize("window", [1, 2])
def test_factors_are_those_of_the_whole_matrix(g, edges, window):
    a = np.zeros((40, 40))
    for u, v in edges:
        a[u, v] = a[v, u] = 1
    step = a / a.sum(1, keepdims=True)
    m = np.log(np.maximum(1, a.sum() / window * sum(np.linalg.matrix_power(step, k + 1) for k in range(window)) / a.sum(0)))
    values, vectors = np.linalg.eigh(m)
    for held in (1 << 24, 0):
        got = {r.id: np.array(r.vec) for r in models.factor_embedding(g, 6, window, held=held).collect()}
        x = np.stack([got[i] for i in range(40)])
        best = np.argsort(-np.abs(values))[:6]
        want = (vectors[:, best] * np.abs(values[best])) @ vectors[:, best].T
        assert np.abs(x @ x.T - want).max() < 0.05 * np.abs(want).max()


def test_recommendations_are_the_best_products(emb):
    users, items = emb.where("id < 10"), emb.where("id >= 10")
    known = users.select(F.col("id").alias("user"), (F.col("id") + 10).alias("item"))
    got = {}
    for blocks in (1, 3):
        for r in models.recommend(users, items, 3, known, blocks).collect():
            got.setdefault(blocks, {})[r.user, r.rk] = r.item
    vec = {r.id: np.array(r.vec) for r in emb.collect()}
    for u in range(10):
        order = sorted((i for i in range(10, 40) if i != u + 10), key=lambda i: (-round(float(vec[u] @ vec[i]), 9), i))
        assert [got[1][u, k + 1] for k in range(3)] == order[:3]
    assert got[1] == got[3]


def test_scanned_counts_scored_pairs_and_real_neighbours_start(g, emb):
    simple = H.Nearest(g, emb=emb, k=4, rounds=2, random_share=0.5)
    found = simple.run().count()
    assert simple.n_scanned() > found and len(simple.scored) >= 2
    assert H.Nearest(g, emb=emb, k=4, rounds=2, method="descent").n_scanned() > 0
    lists = knn.simple(emb, 4, 1, real=2, edges=g.adj, fixed=True)
    assert lists.groupBy("v").count().agg(F.max("count")).first()[0] <= 4


@pytest.mark.parametrize("params", [{"method": "common"}, {"method": "forest"}, {"embedding": "proximity", "structure": False, "community": False}, {"structure": False, "groups": 3, "groups_alt": 2}, {"degree": False, "community": False, "groups": 3, "bailout": 0}, {"method": "ensemble"}])
def test_grouped_search_by_its_params(g, edges, emb, params):
    s = H.GroupSearch(g, **({"k": 12, "embedding": emb} | params))
    got = pairs(s.run())
    assert 0 < len(got) <= 12 and not set(got) & set(edges) and s.n_scanned() == len(got)


def test_grouped_search_says_what_it_lacks(g):
    for params in ({"embedding": "none"}, {"method": "none", "embedding": "proximity"}, {"method": "forest", "embedding": "proximity"}, {"degree": False, "structure": False, "community": False, "embedding": "proximity"}, {"embedding": "proximity"}):
        with pytest.raises(ValueError):
            H.GroupSearch(g, k=3, **params).run()


def test_experiment_budgets(spark, g, emb):
    assert [H.budget_for(m) for m in (10, 100_000, 5_000_000, 10**9)] == [10_000, 100_000, 1_000_000, 10_000_000]
    out, failures = H.experiment(spark, {"toy": g.edges.withColumn("ts", F.lit(1))}, {"cn": {"method": "common"}}, frozenset(["toy"]))
    assert not failures and out.first().method == "cn"


def test_alike_sets_by_least_hashes(spark):
    sets = spark.createDataFrame([(i, m) for i in range(6) for m in (range(30) if i < 3 else range(100 * i, 100 * i + 30)) if not (i == 2 and m < 3)], "item long, member long")
    got = {(r.item, r.other): r.similarity for r in lsh.alike(sets, 0.6, 64, 4).collect()}
    assert set(got) == {(0, 1), (0, 2), (1, 2)} and got[0, 1] == 1.0 and got[0, 2] == pytest.approx(0.9, abs=0.15)


def test_split_checks(spark):
    split = spark.createDataFrame([(1, 2, "train"), (2, 3, "train"), (3, 1, "test"), (2, 1, "test"), (5, 1, "test")], "u long, v long, part string")
    assert [tuple(r) for r in splits.overlap(split).collect()] == [("test", "train", 1)]
    kept, hidden = splits.presplit(split.select(F.col("part").alias("split"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    assert sorted(pairs(kept)) == [(1, 2), (2, 3)] and pairs(hidden) == [(1, 3)]


def test_more_readers_and_writers(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "e.csv.gz", "wt") as f:
        f.write("a,b\n1,2\n2,1\n3,3\n2,3\n")
    assert sorted(pairs(files.csv_edges(spark, str(tmp_path / "e.csv.gz"), True))) == [("1", "2"), ("2", "3")]
    for name in ("train", "valid", "test"):
        spark.createDataFrame([(1, 2), (2, 2), (4, 3)], "source_node long, target_node long").write.parquet(str(tmp_path / "ogb" / name))
    assert files.split_folders(spark, str(tmp_path / "ogb"), source="source_node", target="target_node").count() == 6
    assert files.split_folders(spark, str(tmp_path / "ogb"), source="source_node", target="target_node", both_ways=True).count() == 12
    assert sorted(pairs(files.from_matrix(spark, np.array([[1, 1, 0], [1, 0, 2], [0, 0, 0]])))) == [(0, 1), (1, 2)]
    assert sorted(pairs(files.from_neighbours(spark, {0: [1, 2], 1: [0], 2: []}))) == [(0, 1), (0, 2)]
    (tmp_path / "a.txt").write_text("1 2\n")
    train, test = files.train_and_test(spark, str(tmp_path / "a.txt"), str(tmp_path / "a.txt"), True)
    assert train.columns == test.columns == ["src", "dst", "side_src", "side_dst"]
    made = []
    for _ in range(2):
        vectors = files.cached(spark, str(tmp_path / "v"), lambda: made.append(1) or spark.createDataFrame([(1, [1.0])], "id long, vec array<double>"))
    assert vectors.count() == 1 and made == [1]
    rows = files.homogeneous(spark.createDataFrame([(0, 0, 1.0), (1, 2, 2.0)], "src long, dst long, weight double"))
    assert sorted(map(tuple, rows.collect())) == [(0, 2, 1.0), (1, 4, 2.0), (2, 0, 1.0), (4, 1, 2.0)]
    lines = files.feature_lines(spark.createDataFrame([([1.0, 0.0], [2.0, 3.0], 1)], "vec_u array<double>, vec_v array<double>, y int"))
    assert lines.first().value == "1.0\t0.0\t2.0\t3.0\t1"
    files.write_figures({"num": 3, "R": 0.5}, spark, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m_R")).first()[0] == "0.5"
    record = {"date": "d", "method": "m", "dataset": "x", "statistics": None, "parameters": {}}
    runs = spark.createDataFrame([record | {"h": 2}, record | {"h": 1}], files.RUN)
    files.write_migrated(runs, str(tmp_path / "r"))
    text = [r.value for r in spark.read.text(str(tmp_path / "r")).collect()]
    assert text[-1] == "#" and [r.h for r in files.runs(spark, str(tmp_path / "r")).collect()] == [1, 2]
    assert [r.h for r in metrics.sorted_runs(runs, True).collect()] == [2, 1]
    table = spark.createDataFrame([("b", "1.0"), ("a_c", "XX")], "dataset string, F_h1 string")
    assert [r.value for r in metrics.table_lines(table).collect()] == ["a\\_c & XX \\\\", "b & 1.0 \\\\"]
    files.write_ratings(spark.createDataFrame([("u1", "i2", 3.0)], "user string, item string, rating double"), str(tmp_path / "ra"))
    assert spark.read.text(str(tmp_path / "ra")).first()[0] == "u1\ti2\t3.0"
    letters = spark.createDataFrame([("u1", "i1"), ("u1", "u2")], "a string, b string")
    assert [r[0] for r in letters.select(G.cross_letter(F.col("a"), F.col("b"))).collect()] == [True, False]


def test_link_model_is_kept(spark, emb, tmp_path):
    rows = emb.alias("a").join(emb.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), (F.col("a.id") % 4 == F.col("b.id") % 4).cast("int").alias("y"))
    features = models.pair_features(rows, emb)
    model, score = models.fit_links(features, features, (1.0,), 20)
    models.save_links(model, emb, str(tmp_path / "link"), score)
    again, vectors, accuracy = models.load_links(spark, str(tmp_path / "link"))
    assert accuracy == pytest.approx(score) and vectors.count() == 40 and again.coefficients == model.coefficients


@pytest.mark.parametrize("method", ["groups", "jaccard", "bfs"])
def test_command_line_methods(spark, tmp_path, edges, method):
    (tmp_path / "e.txt").write_text("\n".join(f"n{a} n{b}" for a, b in edges))
    cli.main([str(tmp_path / "e.txt"), str(tmp_path / "out"), "--budget", "40", "--method", method])
    got = {tuple(sorted(r)) for r in map(tuple, spark.read.csv(str(tmp_path / "out")).collect())}
    assert got and not got & {tuple(sorted((f"n{a}", f"n{b}"))) for a, b in edges}
