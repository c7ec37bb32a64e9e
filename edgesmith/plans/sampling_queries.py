"""Queries on forests, bags, walks, recommendation, alike sets and checks of splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgesmith.functions.lineage import cut
from edgesmith.operators import graph as G
from edgesmith.operators import grouped, lsh, metrics, models, sampling, scores, search, splits, wedges
from edgesmith.plans.graph_queries import GU, TEMPORAL, _layers_sql
from edgesmith.plans.selector_queries import CODES, DIST, VE, WEDGES, K
from edgesmith.sources import views as V

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


LIMIT = 500


@query(f"""{CODES}, pr AS (SELECT tree, d, substr(leaf, 1, d) AS prefix, count(*) AS c FROM cd, range(7) r(d) GROUP BY ALL),
vo AS (SELECT tree, d, sum(c * (c - 1) // 2) AS volume FROM pr GROUP BY ALL HAVING sum(c * (c - 1) // 2) >= 0),
st AS (SELECT tree, coalesce(min(d) FILTER (volume <= {5 * LIMIT}), 6) AS stop FROM vo GROUP BY tree),
de AS (SELECT st.tree, CASE WHEN volume < {LIMIT} AND d > 0 THEN d - 1 ELSE d END AS d FROM st JOIN vo ON vo.tree = st.tree AND vo.d = st.stop),
p AS (SELECT DISTINCT a.id AS u, b.id AS v FROM cd a JOIN de USING (tree) JOIN cd b ON b.tree = a.tree AND substr(a.leaf, 1, de.d) = substr(b.leaf, 1, de.d) WHERE a.id < b.id)
SELECT u, v, {DIST.format(a="x.vec", b="y.vec")} AS distance FROM p JOIN ve x ON x.id = u JOIN ve y ON y.id = v ORDER BY distance, u, v LIMIT {LIMIT}""")
def forest_pairs(spark, sf):
    return lsh.forest_pairs(V.vectors(spark, sf), LIMIT, 4, 6, 64, LIMIT)


#: Cells of a fixed grouping of the vectors, with edges between each id and the next but two.
CELLED = f"""WITH {VE}, gu AS (SELECT a.id AS u, b.id AS v FROM ve a JOIN ve b ON b.id = a.id + 3), grp AS (SELECT id AS node, (label % 3)::BIGINT AS grp FROM ve),
ec AS (SELECT least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2, count(*) AS n FROM gu JOIN grp a ON a.node = u JOIN grp b ON b.node = v GROUP BY ALL), pc AS (SELECT *, n / (SELECT sum(n) FROM ec)::DOUBLE AS p FROM ec),
ce AS (SELECT g1, g2, p, greatest(round_even(round(p * {LIMIT}, 9), 0)::BIGINT, 1) AS kappa, round_even(round(sqrt({LIMIT} * p * (1 - p)), 9), 0)::BIGINT AS sigma FROM pc),
ap AS (SELECT least(x.id, y.id) AS u, greatest(x.id, y.id) AS v, -{DIST.format(a="x.vec", b="y.vec")} AS score, g1, g2, kappa, sigma FROM ce JOIN grp a ON a.grp = g1 JOIN grp b ON b.grp = g2 AND (a.node < b.node OR (g1 <> g2 AND a.node > b.node)) JOIN ve x ON x.id = a.node JOIN ve y ON y.id = b.node)"""


@query(f"{CELLED} SELECT u, v, score, g1, g2 FROM ap WHERE NOT EXISTS (SELECT 1 FROM gu WHERE gu.u = ap.u AND gu.v = ap.v) QUALIFY row_number() OVER (PARTITION BY g1, g2 ORDER BY score DESC, u, v) <= kappa + 3 * sigma")
def cell_close_pairs(spark, sf):
    e = V.vectors(spark, sf)
    g = G.Graph(cut(e.select(F.col("id").alias("u"), (F.col("id") + 3).alias("v")).join(e.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")))
    groups = cut(e.select(F.col("id").alias("node"), F.pmod(F.col("label").cast("long"), F.lit(3)).alias("grp")))
    return grouped.close_pairs(g, groups, LIMIT, e)


@query()
def grouped_mixed(spark, sf):
    """Degree bins, structural and community groups together, on vectors of the graph's own, with bailout."""
    g = V.part_graph(spark, sf)
    emb = cut(models.factor_embedding(g, 8, 1))
    groups = cut(grouped.mixed_groups(g, emb))
    return grouped.select(g, groups, K, grouped.close_pairs(g, groups, K, emb), 0.5)


@query(f"""WITH {VE}, us AS (SELECT * FROM ve WHERE id % 2 = 0), it AS (SELECT * FROM ve WHERE id % 2 = 1),
sc AS (SELECT us.id AS user, it.id AS item, round(list_inner_product(us.vec, it.vec), 9) AS score FROM us, it WHERE it.id <> us.id + 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY user ORDER BY score DESC, item) AS rk FROM sc) SELECT user, item, score, rk FROM rk WHERE rk <= 10""")
def recommend_topn(spark, sf):
    e = V.vectors(spark, sf)
    users, items = e.where("id % 2 = 0"), e.where("id % 2 = 1")
    return models.recommend(users, items, 10, users.select(F.col("id").alias("user"), (F.col("id") + 1).alias("item"))).select("user", "item", "score", F.col("rk").cast("long").alias("rk"))


@query(f"{_layers_sql(2)} SELECT q AS node, floor(ln(deg) / ln(2.0) + 1e-9)::BIGINT AS d, round(sum(pow(0.1, hop)), 9) AS x FROM s2 JOIN deg ON deg.node = s2.v GROUP BY ALL")
def structure_features_log(spark, sf):
    g = V.part_graph(spark, sf)
    return models.structure_features(g, search.layers(g, g.all_nodes(), 2), log_base=2.0)


DRAWN = "dn AS (SELECT node, concat_ws('|', md5(concat_ws('|', '42', {bag}, node)), node) AS r FROM deg)"
GROWN = """cl AS (SELECT src, dst FROM adj UNION ALL SELECT node, node FROM deg), co AS (SELECT dst AS node, min(r) AS r FROM cl JOIN {order} ON {order}.node = src GROUP BY dst),
la AS (SELECT max(r) AS r FROM (SELECT r FROM co ORDER BY r, node LIMIT (SELECT ceil(count(*) * {share})::BIGINT FROM deg)))"""


@query(f"{GU}, {DRAWN.format(bag=0)}, {GROWN.format(order='dn', share=0.1)} SELECT 0 AS bag, node FROM co, la WHERE co.r <= la.r")
def node_bag(spark, sf):
    return sampling.bags(V.part_graph(spark, sf), 1)


STEPS = 8
WALKED = f"""{GU.replace("WITH ", "WITH RECURSIVE ", 1)}, {DRAWN.format(bag=0)},
wk(s, node) AS (SELECT 0, arg_min(node, r) FROM dn UNION ALL SELECT s + 1, arg_min(dst, concat(md5(concat_ws('|', '42', 0, s + 1, wk.node, dst)), lpad(dst::VARCHAR, 19, '0'))) FROM wk JOIN adj ON src = wk.node WHERE s < {STEPS} GROUP BY s)"""


@query(f"{WALKED} SELECT DISTINCT least(a.node, b.node) AS u, greatest(a.node, b.node) AS v FROM wk a JOIN wk b ON b.s = a.s + 1")
def walk_subgraph(spark, sf):
    return sampling.walk_subgraph(V.part_graph(spark, sf), STEPS)


@query(f"""{WALKED}, od AS (SELECT dn.node, coalesce(' ' || lpad(min(s)::VARCHAR, 9, '0'), any_value(r)) AS r FROM dn LEFT JOIN wk ON wk.node = dn.node GROUP BY dn.node),
{GROWN.format(order="od", share=0.1)} SELECT 0 AS bag, node FROM co, la WHERE co.r <= la.r""")
def edge_bag(spark, sf):
    return sampling.bags(V.part_graph(spark, sf), 1, mode="edges", steps=STEPS)


@query()
def biased_edge_bag(spark, sf):
    return sampling.bags(V.part_graph(spark, sf), 1, mode="biased", steps=STEPS)


@query(f"""{GU}, bg AS (SELECT (node % 3)::INT AS bag, node FROM deg), be AS (SELECT a.bag, u, v FROM gu JOIN bg a ON a.node = u JOIN bg b ON b.node = v AND b.bag = a.bag),
bd AS (SELECT bag, node, count(*) AS d FROM (SELECT bag, u AS node FROM be UNION ALL SELECT bag, v FROM be) GROUP BY ALL),
rk AS (SELECT be.*, row_number() OVER (PARTITION BY be.bag ORDER BY least(x.d, y.d) DESC, u, v) AS r, count(*) OVER (PARTITION BY be.bag) AS m FROM be JOIN bd x ON x.bag = be.bag AND x.node = u JOIN bd y ON y.bag = be.bag AND y.node = v)
SELECT bag, u, v FROM rk WHERE r <= floor(m * 0.75)""")
def filter_bags(spark, sf):
    g = V.part_graph(spark, sf)
    members = g.all_nodes().select(F.pmod("node", F.lit(3)).cast("int").alias("bag"), "node")
    return models.filter_bags(cut(models.in_bags(g, members)))


@query(f"WITH {VE}, f AS (SELECT id AS node, unnest(range(64))::INT AS c, unnest(vec) AS f FROM ve) SELECT node, c, f, row_number() OVER (PARTITION BY c ORDER BY f DESC, node)::INT AS rk FROM f WHERE f > 0")
def factor_columns(spark, sf):
    return models.sorted_columns(V.vectors(spark, sf).select(F.col("id").alias("node"), F.posexplode("vec").alias("c", "f")))


@query(f"""WITH {VE}, f AS (SELECT id AS node, 0 AS bag, unnest(range(64))::INT AS c, greatest(unnest(vec), 0) AS f FROM ve), e AS (SELECT 0 AS bag, a.id AS u, b.id AS v FROM ve a JOIN ve b ON b.id = a.id + 1),
i AS (SELECT sum(2 * x.f * y.f) AS s FROM e JOIN f x ON x.node = u JOIN f y ON y.node = v AND y.c = x.c), g AS (SELECT sum(s * s) AS s FROM (SELECT sum(x.f * y.f) AS s FROM f x JOIN f y ON x.node = y.node GROUP BY x.c, y.c))
SELECT 0 AS bag, round(sqrt((SELECT 2 * count(*) FROM e) - 2 * i.s + g.s), 9) AS error FROM i, g""")
def factor_error(spark, sf):
    e = V.vectors(spark, sf)
    f = e.select(F.col("id").alias("node"), F.lit(0).alias("bag"), F.posexplode("vec").alias("c", "f")).withColumn("f", F.greatest("f", F.lit(0.0)))
    pairs = e.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).join(e.select(F.col("id").alias("v")), "v", "left_semi").select(F.lit(0).alias("bag"), "u", "v")
    return models.factor_error(pairs, f)


PERMUTATIONS = 16


@query(f"""WITH {V.PURCHASES}, st AS (SELECT DISTINCT v AS item, u AS member FROM gb), lh AS (SELECT item, i, min(substr(md5(concat_ws('|', '42', i, member)), 1, 12)) AS h FROM st, range({PERMUTATIONS}) r(i) GROUP BY ALL),
bk AS (SELECT item, i // 2 AS band, string_agg(h, '' ORDER BY i) AS key FROM lh GROUP BY ALL), mt AS (SELECT DISTINCT a.item, b.item AS other FROM bk a JOIN bk b USING (band, key) WHERE a.item < b.item),
si AS (SELECT mt.item, mt.other, count(*) FILTER (a.h = b.h) / {PERMUTATIONS} AS similarity FROM mt JOIN lh a ON a.item = mt.item JOIN lh b ON b.item = mt.other AND b.i = a.i GROUP BY ALL)
SELECT item, other, similarity FROM si WHERE similarity > 0.1""")
def alike_sets(spark, sf):
    sets = V.purchases(spark, sf).select(F.col("v").alias("item"), F.col("u").alias("member")).distinct()
    return lsh.alike(sets, 0.1, PERMUTATIONS, 2)


COUNTED = f"WITH {V.PURCHASE_ADJ}, nb AS (SELECT a.*, deg, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM adj a JOIN deg ON node = src), y0 AS (SELECT node, 1 AS walk, node AS loc FROM deg)"


def _draw(s: int, what: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '42', y.node, y.walk, {s}, '{what}')), 1, 7))::BIGINT"


def _walk_sql(steps: int, hops: int, stop: float, restart: float) -> str:
    sql = COUNTED
    for s in range(1, steps + 1):
        two = f"JOIN nb b ON b.src = a.dst AND b.i = {_draw(s, 'two')} % b.deg" if hops == 2 else ""
        to = "b.dst" if hops == 2 else "a.dst"
        to = f"CASE WHEN {_draw(s, 'restart')} < {int(restart * (1 << 28))} THEN y.node ELSE {to} END" if restart else to
        sql += f", y{s} AS MATERIALIZED (SELECT y.node, y.walk, {to} AS loc FROM y{s - 1} y JOIN nb a ON a.src = y.loc AND a.i = {_draw(s, 'one')} % a.deg {two} WHERE {_draw(s, 'stop')} >= {int(stop * (1 << 28))})"
    return sql + " " + " UNION ALL ".join(f"SELECT node, walk, {s} AS pos, loc AS at FROM y{s}" for s in range(steps + 1))


def _walked(spark, sf, **how):
    g = V.purchase_graph(spark, sf)
    return models.walk_corpus(g, g.all_nodes().select("node", F.lit(1).alias("walks")), **how).select("node", F.col("walk").cast("int").alias("walk"), F.col("pos").cast("int").alias("pos"), "at")


@query(_walk_sql(6, 1, 0.15, 0.0))
def walk_one_hop(spark, sf):
    return _walked(spark, sf, steps=6, hops=1)


@query(_walk_sql(4, 2, 0.0, 0.2))
def walk_restart(spark, sf):
    return _walked(spark, sf, steps=4, stop=0.0, restart=0.2)


@query(f"{GU}, {TEMPORAL}, tr AS (SELECT u AS x FROM sp WHERE part <> 'test' UNION SELECT v FROM sp WHERE part <> 'test') SELECT u, v FROM sp WHERE part = 'test' AND u IN (SELECT x FROM tr) AND v IN (SELECT x FROM tr)")
def reachable_test_edges(spark, sf):
    split = cut(splits.temporal_split(V.part_graph(spark, sf).edges))
    return splits.touching(split.where("part = 'test'").select("u", "v"), splits.train_graph(split))


@query(f"{GU}, {TEMPORAL}, pa AS (SELECT u, v, part FROM sp UNION ALL SELECT v, u, 'again' FROM sp WHERE part = 'test') SELECT 'again' AS a, 'test' AS b, count(*) AS n FROM pa x JOIN pa y ON x.part = 'again' AND y.part = 'test' AND x.u = y.v AND x.v = y.u")
def split_overlap(spark, sf):
    split = cut(splits.temporal_split(V.part_graph(spark, sf).edges))
    again = split.where("part = 'test'").select(F.col("v").alias("u"), F.col("u").alias("v"), F.lit("again").alias("part"))
    return splits.overlap(split.unionByName(again))


ALL = f"WITH {V.ALL_ORDERS}"


@query(f"{ALL} SELECT u, v, weight, ts FROM gu")
def all_graph_edges(spark, sf):
    return V.shared_orders(spark, sf, None)


@query(f"{ALL} SELECT node, deg FROM deg")
def all_degree(spark, sf):
    return V.part_graph(spark, sf, None).degree


@query(f"{ALL}, {TEMPORAL} SELECT * FROM sp")
def all_split_temporal(spark, sf):
    return splits.temporal_split(V.part_graph(spark, sf, None).edges)


@query(f"{WEDGES.replace(GU, ALL)} SELECT u, v, adamic_adar FROM s ORDER BY adamic_adar DESC, u, v LIMIT 1000")
def all_adamic_adar_topk(spark, sf):
    return wedges.top_adamic_adar(V.shared_orders(spark, sf, None).select("u", "v"), 1000)


@query(f"{WEDGES}, n AS (SELECT count(*)::DOUBLE AS n FROM deg), p AS (SELECT u, v FROM s ORDER BY common DESC, u, v LIMIT 1000) SELECT count(*) AS n_pairs, round(count(*) / (any_value(n) * any_value(n)), 9) AS prune FROM p, n")
def prune_share(spark, sf):
    g = V.part_graph(spark, sf)
    return metrics.prune_share(scores.top_pairs(scores.wedge_scores(g), "common", 1000), g.size()[0])
