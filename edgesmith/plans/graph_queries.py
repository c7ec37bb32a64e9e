"""Queries on graph structure, splits, scores, walks and searches, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgesmith.operators import graph as G
from edgesmith.operators import scores, search, splits, walkblocks, walkrank
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


GU = f"WITH {V.SHARED_ORDERS}"


@query(f"{GU} SELECT u, v, weight, ts FROM gu")
def graph_edges(spark, sf):
    return V.shared_orders(spark, sf)


@query(f"{GU} SELECT src, dst FROM adj")
def graph_symmetric(spark, sf):
    return G.symmetric(V.shared_orders(spark, sf))


@query(f"{GU} SELECT (SELECT count(*) FROM deg) AS n, count(*) AS m, count(*) / (SELECT count(*) FROM deg) AS edges_per_node FROM gu")
def graph_totals(spark, sf):
    return V.part_graph(spark, sf).totals()


@query(f"{GU} SELECT node, deg FROM deg")
def degree(spark, sf):
    return V.part_graph(spark, sf).degree


@query(f"""{GU}, t AS (SELECT floor(log10(max(deg)))::INT AS stop FROM deg), e AS (SELECT i, pow(10.0, i * stop / 24.0) AS edge FROM t, range(25) r(i))
SELECT node, deg, (SELECT count(*) FROM e WHERE edge <= deg + 1e-9) - 1 AS bin FROM deg""")
def degree_bins(spark, sf):
    return G.degree_bins(V.part_graph(spark, sf).degree)


@query(f"WITH {V.PURCHASES} SELECT u, v, ts FROM gb")
def bipartite_edges(spark, sf):
    return V.purchases(spark, sf)


@query(f"WITH {V.PURCHASES} SELECT a.u, b.u AS v, count(*) AS weight FROM gb a JOIN gb b ON a.v = b.v AND a.u < b.u GROUP BY ALL")
def bipartite_projection(spark, sf):
    return G.projection(V.purchases(spark, sf))


PARTS = "CASE WHEN rn <= m - r1 - r2 - r3 THEN 'rest' WHEN rn <= m - r2 - r3 THEN 'train' WHEN rn <= m - r3 THEN 'valid' ELSE 'test' END AS part"
SIZES = "count(*) OVER () AS m, round_even(count(*) OVER () * 0.2::DOUBLE, 0)::BIGINT AS r1, round_even(count(*) OVER () * 0.1::DOUBLE, 0)::BIGINT AS r2, round_even(count(*) OVER () * 0.2::DOUBLE, 0)::BIGINT AS r3"
TEMPORAL = f"sp AS (SELECT u, v, {PARTS} FROM (SELECT u, v, row_number() OVER (ORDER BY ts, u, v) AS rn, {SIZES} FROM gu))"


@query(f"{GU} SELECT u, v, {PARTS} FROM (SELECT u, v, row_number() OVER (ORDER BY md5(concat_ws('|', '42', u, v)), u, v) AS rn, {SIZES} FROM gu)")
def split_static(spark, sf):
    return splits.static_split(V.part_graph(spark, sf).edges)


@query(f"{GU}, {TEMPORAL} SELECT * FROM sp")
def split_temporal(spark, sf):
    return splits.temporal_split(V.part_graph(spark, sf).edges)


@query(f"{GU}, {TEMPORAL} SELECT u, v FROM sp WHERE part <> 'test'")
def train_graph(spark, sf):
    return splits.train_graph(splits.temporal_split(V.part_graph(spark, sf).edges))


@query(f"{GU} SELECT node FROM deg ORDER BY md5(concat_ws('|', '42', node)), node LIMIT 100")
def sample_nodes(spark, sf):
    return splits.sample_nodes(V.part_graph(spark, sf).all_nodes(), 100)


@query(f"""{GU}, k AS (SELECT node, row_number() OVER (ORDER BY node) AS rn, count(*) OVER () AS n FROM deg), s AS (SELECT max(n) AS n FROM k), sz AS (SELECT (round_even(count(*) * 0.2::DOUBLE, 0) + round_even(count(*) * 0.1::DOUBLE, 0))::BIGINT AS c FROM gu),
d AS (SELECT i AS id, ('0x' || substr(md5(concat_ws('|', '42', i, 0)), 1, 7))::BIGINT % n + 1 AS a, ('0x' || substr(md5(concat_ws('|', '42', i, 1)), 1, 7))::BIGINT % n + 1 AS b FROM s, range((SELECT 2 * c FROM sz)::BIGINT) r(i)),
p AS (SELECT least(x.node, y.node) AS u, greatest(x.node, y.node) AS v, min(id) AS id FROM d JOIN k x ON x.rn = a JOIN k y ON y.rn = b WHERE a <> b GROUP BY ALL)
SELECT u, v FROM p WHERE NOT EXISTS (SELECT 1 FROM gu WHERE gu.u = p.u AND gu.v = p.v) ORDER BY id LIMIT (SELECT c FROM sz)""")
def negatives(spark, sf):
    g = V.part_graph(spark, sf)
    n, m = g.size()
    return splits.negatives(g.edges, n, round(0.2 * m) + round(0.1 * m))


WEDGES = f"""{GU}, w AS (SELECT x.dst AS u, y.dst AS v, count(*) AS common, sum(1 / ln(d.deg::DOUBLE)) AS aa FROM adj x JOIN adj y ON x.src = y.src AND x.dst < y.dst JOIN deg d ON d.node = x.src GROUP BY ALL),
s AS (SELECT w.u, w.v, common, round(aa, 9) AS adamic_adar, round(common / (a.deg + b.deg - common), 9) AS jaccard FROM w JOIN deg a ON a.node = w.u JOIN deg b ON b.node = w.v
      WHERE NOT EXISTS (SELECT 1 FROM gu WHERE gu.u = w.u AND gu.v = w.v))"""


def _top(by: str) -> str:
    return f"{WEDGES} SELECT u, v, {by} FROM s ORDER BY {by} DESC, u, v LIMIT 1000"


@query(_top("common"))
def common_neighbors_topk(spark, sf):
    return scores.top_pairs(scores.wedge_scores(V.part_graph(spark, sf)), "common", 1000)


@query(_top("adamic_adar"))
def adamic_adar_topk(spark, sf):
    return scores.top_pairs(scores.wedge_scores(V.part_graph(spark, sf)), "adamic_adar", 1000)


@query(_top("jaccard"))
def jaccard_topk(spark, sf):
    return scores.top_pairs(scores.wedge_scores(V.part_graph(spark, sf)), "jaccard", 1000)


@query(f"""{GU} SELECT u, v, least(a.deg, b.deg) AS least_deg FROM gu JOIN deg a ON a.node = u JOIN deg b ON b.node = v
ORDER BY least_deg DESC, u, v LIMIT (SELECT floor(count(*) * 0.75::DOUBLE)::BIGINT FROM gu)""")
def edge_filter(spark, sf):
    return G.filter_edges(V.part_graph(spark, sf))


def _walk_sql(base: str, rounds: int, keep: int) -> str:
    """Truncated PageRank with a budget of one pair an edge, unrolled."""
    sql = f"WITH {base}, lim AS (SELECT node AS q, deg, deg * 0.5::DOUBLE AS k, ceil(deg * 0.5::DOUBLE * {keep})::BIGINT AS trunc FROM deg), p0 AS (SELECT q, q AS v, 1.0::DOUBLE AS p, 1 AS rk FROM lim)"
    for i in range(1, rounds + 1):
        sql += f""",
c{i} AS (SELECT a.src AS q, s.v, 0.8::DOUBLE / l.deg * s.p AS p FROM adj a JOIN lim l ON l.q = a.src JOIN p{i - 1} s ON s.q = a.dst WHERE s.rk <= l.trunc UNION ALL SELECT q, q, 1 - 0.8::DOUBLE FROM lim),
g{i} AS (SELECT q, v, sum(p) AS p FROM c{i} GROUP BY ALL),
r{i} AS (SELECT q, v, p, row_number() OVER (PARTITION BY q ORDER BY round(p, 12) DESC, v) AS rk FROM g{i}),
p{i} AS MATERIALIZED (SELECT r.q, v, p, rk FROM r{i} r JOIN lim USING (q) WHERE rk <= trunc)"""
    return sql


WALK = _walk_sql(V.SHARED_ORDERS, 3, 5)


def _walker(graph, keep=5, bipartite=False):
    return walkrank.TruncatedPageRank(graph, graph.size()[1], keep=keep, bipartite=bipartite)


@query(f"{WALK} SELECT q, v, round(p, 9) AS p FROM p3")
def walk_state(spark, sf):
    return _walker(V.part_graph(spark, sf)).state(3).select("q", "v", F.round("p", 9).alias("p"))


@query(f"""{WALK}, d AS (SELECT p2.p AS a, p3.p AS b FROM p2 FULL JOIN p3 ON p2.q = p3.q AND p2.v = p3.v),
w AS (SELECT CASE WHEN a IS NULL OR b IS NULL THEN 1.0 ELSE 2.0 END::DOUBLE AS w, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM d)
SELECT round(sum(w * abs(a - b)), 6) AS delta, round(sum(w * a), 6) AS total FROM w""")
def walk_convergence(spark, sf):
    w = _walker(V.part_graph(spark, sf))
    two = w.state(2)
    return w.change(two, w.step(two)).select(F.round("delta", 6).alias("delta"), F.round("total", 6).alias("total"))


def _emit(edges: str, extra: str = "") -> str:
    return f""", f AS (SELECT s.q, s.v, round(p, 12) AS p, k, row_number() OVER (PARTITION BY s.q ORDER BY rk) AS er FROM p3 s JOIN lim l ON l.q = s.q WHERE s.q <> s.v {extra} AND NOT EXISTS (SELECT 1 FROM adj WHERE src = s.q AND dst = s.v)),
x AS (SELECT least(q, v) AS u, greatest(q, v) AS v, p, k, er FROM f), picks AS (SELECT DISTINCT u, v FROM x WHERE er <= floor(k)),
pool AS (SELECT u, v, max(p) AS p FROM x WHERE er > floor(k) AND er <= floor(k) + ceil(k) AND NOT EXISTS (SELECT 1 FROM picks WHERE picks.u = x.u AND picks.v = x.v) GROUP BY ALL)
SELECT u, v FROM picks UNION ALL (SELECT u, v FROM pool ORDER BY p DESC, u, v LIMIT (SELECT greatest(0, (SELECT count(*) FROM {edges}) - count(*)) FROM picks))"""


@query(WALK + _emit("gu"))
def walk_candidates(spark, sf):
    w = _walker(V.part_graph(spark, sf))
    return w.candidates(w.state(3))


@query(_walk_sql(V.PURCHASE_ADJ, 3, 4) + _emit("gb", "AND s.q % 2 <> s.v % 2"))
def walk_candidates_bipartite(spark, sf):
    return walkblocks.walk(V.purchases(spark, sf).select("u", "v"), keep=4, bipartite=True, iterations=3)[0]


SOURCES = "src0 AS (SELECT node AS q FROM deg)"


def _pagerank_sql(rounds: int) -> str:
    sql = f"{GU}, {SOURCES}, p0 AS (SELECT q, q AS v, 1.0::DOUBLE AS p FROM src0)"
    for i in range(1, rounds + 1):
        sql += f", p{i} AS MATERIALIZED (SELECT q, v, sum(p) AS p FROM (SELECT s.q, a.dst AS v, 0.8::DOUBLE * p / d.deg AS p FROM p{i - 1} s JOIN adj a ON a.src = s.v JOIN deg d ON d.node = a.src UNION ALL SELECT q, q, 1 - 0.8::DOUBLE FROM src0) GROUP BY ALL)"
    return sql + f""", r AS (SELECT q, v, p, row_number() OVER (PARTITION BY q ORDER BY round(p, 12) DESC, v) AS rk FROM p{rounds} s WHERE q <> v AND NOT EXISTS (SELECT 1 FROM adj WHERE src = q AND dst = s.v))
SELECT q, v, round(p, 9) AS p FROM r WHERE rk <= 10"""


@query(_pagerank_sql(3))
def ppr_topk(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.pagerank(g, g.all_nodes(), 10, iterations=3)


def _restart_sql(steps: int) -> str:
    sql = f"{GU}, {SOURCES}, nb AS (SELECT a.*, d.deg, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM adj a JOIN deg d ON d.node = src), m0 AS (SELECT q, q AS v, q AS pos FROM src0)"
    for s in range(steps):
        h = lambda what: f"('0x' || substr(md5(concat_ws('|', '42', q, {s}, '{what}')), 1, 7))::BIGINT"  # noqa: B023, E731
        sql += f", m{s + 1} AS MATERIALIZED (SELECT q, dst AS v, CASE WHEN {h('back')} < {int(0.1 * (1 << 28))} THEN q ELSE dst END AS pos FROM m{s} JOIN nb ON src = pos AND i = {h('step')} % deg)"
    return sql + ", vis AS (SELECT q, v, count(*) AS visits FROM (" + " UNION ALL ".join(f"SELECT q, v FROM m{s + 1}" for s in range(steps)) + ") GROUP BY ALL)"


@query(f"{_restart_sql(6)} SELECT * FROM vis")
def restart_visits(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.restart_walks(g, g.all_nodes(), 6)


@query(f"{_restart_sql(6)}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY visits DESC, v) AS rk FROM vis s WHERE q <> v AND NOT EXISTS (SELECT 1 FROM adj WHERE src = q AND dst = s.v)) SELECT q, v, visits FROM r WHERE rk <= 3")
def restart_topk(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.restart_candidates(g, g.all_nodes(), 3, 6)


def _layers_sql(depth: int) -> str:
    sql = f"{GU}, {SOURCES}, s0 AS (SELECT q, q AS v, 0 AS hop FROM src0)"
    for i in range(1, depth + 1):
        sql += f", s{i} AS MATERIALIZED (SELECT * FROM s{i - 1} UNION ALL SELECT DISTINCT s.q, a.dst, {i} FROM s{i - 1} s JOIN adj a ON a.src = s.v WHERE s.hop = {i - 1} AND NOT EXISTS (SELECT 1 FROM s{i - 1} z WHERE z.q = s.q AND z.v = a.dst))"
    return sql


# the selectors with their own defaults and stopping rules, which SQL of a fixed length cannot say


@query()
def walk_candidates_full(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.TruncatedPageRank(g, g.edges.count()).run()


@query()
def ppr_topk_full(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.pagerank(g, g.all_nodes(), 10)


@query()
def restart_visits_full(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.restart_walks(g, g.all_nodes())


@query()
def restart_topk_full(spark, sf):
    g = V.part_graph(spark, sf)
    return walkrank.restart_candidates(g, g.all_nodes(), 3)


@query(f"{_layers_sql(2)} SELECT * FROM s2")
def khop_layers(spark, sf):
    g = V.part_graph(spark, sf)
    return search.layers(g, g.all_nodes(), 2)


@query(f"{_layers_sql(4)}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY hop, v) AS rk FROM s4 WHERE hop > 0) SELECT q, v, hop FROM r WHERE rk <= 40")
def bfs_topk(spark, sf):
    g = V.part_graph(spark, sf)
    return search.bfs_candidates(g, g.all_nodes(), 40)
