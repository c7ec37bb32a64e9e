"""Vectors that every task holds, against the joins that go beyond them."""

import numpy as np
from pyspark.sql import functions as F

from edgesmith.operators import held, knn


def _table(spark, n=300, width=5, seed=3):
    rng = np.random.default_rng(seed)
    vec = np.round(rng.normal(size=(n, width)), 1)
    return spark.createDataFrame([(int(7 * i - 50), [float(x) for x in v], int(i % 4) if i % 9 else None) for i, v in enumerate(vec)], "id long, vec array<double>, label int")


def _rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=str)


def test_all_pairs_are_scored_without_a_join(spark):
    emb = _table(spark, 1200)  # more than a tile
    every = knn.exhaustive(emb)
    assert "Join" not in _plan(every)
    assert every.count() == 1200 * 1199 // 2
    assert every.exceptAll(knn.exhaustive(emb, blocks=3)).count() == 0


def test_odd_vectors_go_by_joins(spark):
    emb = _table(spark, 6)
    assert held.hold(emb, most=29) is None
    assert held.hold(emb.unionByName(emb)) is None
    for odd in (F.lit(None).cast("array<double>"), F.array(F.lit(1.0)), F.transform("vec", lambda x: F.lit(float("nan")))):
        uneven = emb.withColumn("vec", F.when(F.col("id") == -43, odd).otherwise(F.col("vec")))
        assert held.hold(uneven) is None
        assert knn.exhaustive(uneven).count() == 15
    assert knn.exhaustive(emb.limit(0)).count() == 0


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_confidence_counts_without_a_join(spark):
    from edgesmith.plans import catalogue

    assert "Join" not in _plan(catalogue.QUERIES["exhaustive_confidence"](spark, "/root/testdata/sf0.001"))


def test_labels_of_both_ends_come_with_the_pairs(spark):
    from edgesmith.plans import catalogue

    emb = _table(spark, 90)
    more = ("label", "lu", "lv")
    assert _rows(knn.exhaustive(emb, more=more), "u", "v", "score", "lu", "lv") == _rows(knn.exhaustive(emb, blocks=2, more=more), "u", "v", "score", "lu", "lv")
    assert "Join" not in _plan(catalogue.QUERIES["average_precision"](spark, "/root/testdata/sf0.001"))


def test_truth_by_a_condition_or_a_table(spark):
    from edgesmith.operators import models
    from edgesmith.plans import catalogue

    scored = spark.createDataFrame([(1, 2, 0.5, True), (1, 3, 0.25, None), (2, 3, 0.75, False)], "u long, v long, p double, same boolean")
    assert _rows(models.with_truth(scored, F.col("same")), "u", "v", "p") == _rows(models.with_truth(scored, scored.where("same")), "u", "v", "p")
    assert "Join" not in _plan(catalogue.QUERIES["oracle_perfect"](spark, "/root/testdata/sf0.001"))


def test_recommendations_by_held_vectors_agree_with_blocks(spark):
    from edgesmith.operators import models

    emb = _table(spark, 400, 2)  # coarse entries: many ties
    users, items = emb.where("id % 2 = 0"), emb.where("id % 2 <> 0")
    known = items.select("id").limit(60).crossJoin(users.limit(3).select(F.col("id").alias("user"))).select("user", F.col("id").alias("item"))
    for some in (None, known):
        got, want = models.recommend(users, items, 4, some), models.recommend(users, items, 4, some, 3)
        assert "GenerateExec" not in _plan(got) and "explode" not in _plan(got)
        assert _rows(got, "user", "item", "score", "rk") == _rows(want, "user", "item", "score", "rk")
    assert models.recommend(users, items.limit(0), 4).count() == models.recommend(users.limit(0), items, 4).count() == 0


def test_first_pairs_of_cells_agree_with_joins(spark):
    from edgesmith.operators import grouped

    emb = _table(spark, 700, 2)  # cells of more than a strip, with ties
    groups = emb.select(F.col("id").alias("node"), F.col("label").alias("grp"))
    wanted = spark.createDataFrame([(0, 0), (0, 1), (1, 2), (3, 9)], "g1 int, g2 int")
    got = grouped.first_vector_pairs(emb, groups, wanted, 15)
    want = grouped._ranked(grouped.vector_pairs(emb, groups, wanted), F.lit(15))
    cols = ("u", "v", "score", "g1", "g2")
    assert _rows(got, *cols) == _rows(want, *cols) and got.count() == 45
    assert "Join" not in _plan(got)


def test_products_round_as_sums_entry_by_entry():
    rng = np.random.default_rng(8)
    x, y = np.round(rng.normal(size=(70, 9)), 5), np.round(rng.normal(size=(90, 9)), 5)  # many sums end on half of the last digit
    x[0] = y[0] = 0
    assert np.array_equal(held.rounded_dots(x, y), held.rounded(held.dots(x, y)))
    assert np.array_equal(held.rounded_dots(x, y, one_less=True), held.rounded(1 - held.dots(x, y)))
    assert np.array_equal(held.rounded_dots(x * 1e12, y), held.rounded(held.dots(x * 1e12, y)))


def test_pairs_are_counted_where_they_are_scored(spark):
    emb = _table(spark, 1200)
    bars = {"sure": 0.9, "likely": -0.25}
    got = knn.count_above(emb, bars)
    assert "score" not in _plan(got)
    assert got.first().asDict() == knn.count_above(emb.withColumn("id", F.col("id").cast("string")), bars).first().asDict()
    assert tuple(knn.count_above(emb.limit(0), bars).first()) == (0, 0, 0)


def test_closest_pairs_of_leaves_agree_with_joins(spark, monkeypatch):
    from edgesmith.operators import lsh

    emb = _table(spark, 500, 3)  # leaves of more than a strip, with ties
    leaves = lsh.codes(emb, 3, 2, 3).unionByName(spark.createDataFrame([(-999, 0, "00"), (None, 0, "00"), (6, 0, None)], "id long, tree long, leaf string"))
    want = lsh.pairs(emb, leaves).orderBy("distance", "u", "v").limit(400)
    got = lsh.pairs(emb, leaves, 400)
    assert _rows(got, "u", "v", "distance") == _rows(want, "u", "v", "distance")
    assert "Join" not in _plan(got)
    assert lsh.pairs(emb, leaves.limit(0), 5).count() == lsh.pairs(emb.limit(0), leaves, 5).count() == 0
    edges = want.select("u", "v").limit(90)
    assert "Join" not in _plan(lsh.forest_pairs(emb, 50, 3, 4, 3, 2000))
    got = _rows(lsh.forest_pairs(emb, 120, 3, 4, 3, 2000, edges), "u", "v", "distance")
    monkeypatch.setattr(held, "hold", lambda *_: None)
    assert got == _rows(lsh.forest_pairs(emb, 120, 3, 4, 3, 2000, edges), "u", "v", "distance") and len(got) == 120


def test_pairs_by_factors_agree_with_joins(spark, monkeypatch):
    from edgesmith.operators import models

    f = _table(spark, 300, 6).select(F.col("id").alias("node"), F.posexplode("vec").alias("c", "f"))  # many products on the bar
    f = f.unionByName(spark.createDataFrame([(None, 0, 2.0), (7, None, 2.0), (7, 0, None), (6, 0, 1.0)], "node long, c int, f double"))
    got = models.factor_pairs(f, 3.0)
    assert "Join" not in _plan(got)
    rows = _rows(got, "u", "v", "score")
    monkeypatch.setattr(held, "HELD", 0)
    assert rows == _rows(models.factor_pairs(f, 3.0), "u", "v", "score") and len(rows) > 1000
    monkeypatch.undo()
    assert models.factor_pairs(f.limit(0), 3.0).count() == models.factor_pairs(f, 1e9).count() == 0


def test_links_fitted_in_tasks_agree_with_joins(spark, monkeypatch):
    from edgesmith.operators import models
    from edgesmith.plans import catalogue
    from edgesmith.sources import views

    emb = _table(spark, 150, 4).where("label is not null").withColumn("vec", F.transform("vec", lambda x: x / 2 + F.col("label") / 4))
    monkeypatch.setattr(views, "vectors", lambda *_: emb)
    run = catalogue.QUERIES["logistic_scores"]
    got = run(spark, "")
    assert "Join" not in _plan(got)
    with monkeypatch.context() as m:
        m.setattr(models, "fit_links", lambda fit, valid, grid, rounds, f=models.fit_links: f(fit, valid, grid, 300))
        m.setattr(held, "hold", lambda *_: None)
        want = {(r.u, r.v): r.p for r in run(spark, "").collect()}
    rows = {(r.u, r.v): r.p for r in got.collect()}
    assert rows.keys() == want.keys() and max(abs(rows[k] - want[k]) for k in rows) < 1e-3
    assert max(rows.values()) - min(rows.values()) > 0.1


def test_close_pairs_of_cells_agree_with_joins(spark, monkeypatch):
    from edgesmith.operators import grouped
    from edgesmith.operators.graph import Graph

    emb = _table(spark, 400, 2)
    near = emb.select(F.col("id").alias("u"), (F.col("id") + 7 * F.pmod("id", F.lit(3)) + 7).alias("v")).join(emb.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")
    g, groups = Graph(near.cache()), emb.where("label is not null").select(F.col("id").alias("node"), F.col("label").cast("long").alias("grp"))
    made = [_rows(grouped.close_pairs(g, groups, 300, emb, tolerance), "u", "v", "score", "g1", "g2") for tolerance in (grouped.EXACT, 7_000)]
    met = []
    monkeypatch.setattr(grouped, "vector_pairs", lambda *x, f=grouped.vector_pairs: met.append(x) or f(*x))
    grouped.close_pairs(g, groups, 300, emb)
    assert not met  # no cell goes by joins
    monkeypatch.setattr(held, "hold", lambda *_: None)
    assert made == [_rows(grouped.close_pairs(g, groups, 300, emb, tolerance), "u", "v", "score", "g1", "g2") for tolerance in (grouped.EXACT, 7_000)]
    assert met and len(made[0]) >= 300


def test_links_fitted_by_squares_reach_the_optimum(spark, monkeypatch):
    from edgesmith.operators import links

    emb = _table(spark, 180, 4).where("label is not null").withColumn("vec", F.transform("vec", lambda x: x / 2 + F.col("label") / 4))
    vectors = held.hold(emb, "label")
    monkeypatch.setattr(links, "ROWS", 16)
    monkeypatch.setattr(links, "WIDE", 50)
    shared = spark.sparkContext.broadcast(vectors)
    drawn = links.draw(spark, shared, 42)
    exact = links.fit(drawn, shared, (1.0,))[0]
    monkeypatch.setattr(links, "BENDS", 200)  # the bend of a part of the pairs, the slope of all
    part = links.fit(drawn, shared, (1.0,))[0]
    assert np.abs(part - exact).max() < 1e-5
    i, j = np.triu_indices(len(vectors.ids), 1)
    taken = np.array([np.unpackbits(np.frombuffer(r.fit, np.uint8), count=r.j) for r in drawn.orderBy("j").collect()], dtype=object)
    keep = np.array([bool(taken[b][a]) for a, b in zip(i, j, strict=True)])
    i, j = i[keep], j[keep]
    x = np.column_stack([np.ones(len(i)), vectors.matrix[i] * vectors.matrix[j]])
    y, p = vectors.more[i] == vectors.more[j], 1 / (1 + np.exp(-x @ exact))
    slope = x.T @ (p - y) / len(y) + np.append(0, exact[1:]) / len(y)
    assert np.abs(slope).max() < 1e-7 and 0.01 < y.mean() < 0.99
