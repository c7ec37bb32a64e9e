"""Queries on grouped selection, vectors, models, walks and run analytics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from edgesmith.functions.lineage import cut, row_numbers
from edgesmith.functions.portable import digest
from edgesmith.operators import graph as G
from edgesmith.operators import grouped, held, knn, links, lsh, metrics, models, scores, search, shapes, splits
from edgesmith.plans.graph_queries import GU, PARTS, SIZES, SOURCES, TEMPORAL, WEDGES, _layers_sql
from edgesmith.sources import files
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


K = 2000
BINS = """, t AS (SELECT floor(log10(max(deg)))::INT AS stop FROM deg), e AS (SELECT i, pow(10.0, i * stop / 24.0) AS edge FROM t, range(25) r(i)),
dg AS (SELECT node, (SELECT count(*) FROM e WHERE edge <= deg + 1e-9) - 1 AS grp FROM deg)"""
CELLS = f""", ec AS (SELECT least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2, count(*) AS n FROM gu JOIN grp a ON a.node = u JOIN grp b ON b.node = v GROUP BY ALL),
gs AS (SELECT grp, count(*) AS c FROM grp GROUP BY grp),
pc AS (SELECT *, n / (SELECT sum(n) FROM ec)::DOUBLE AS p FROM ec),
cells AS (SELECT pc.g1, pc.g2, n, p, greatest(round_even(round(p * {K}, 9), 0)::BIGINT, 1) AS kappa, round_even(round(sqrt({K} * p * (1 - p)), 9), 0)::BIGINT AS sigma, (a.c * b.c)::BIGINT AS size
          FROM pc JOIN gs a ON a.grp = g1 JOIN gs b ON b.grp = g2)"""
TURNS = """, tc AS (SELECT *, kappa - sigma >= size AS whole, row_number() OVER (ORDER BY p DESC, g1, g2) AS turn FROM cells),
wh AS (SELECT DISTINCT least(a.node, b.node) AS u, greatest(a.node, b.node) AS v, turn FROM tc JOIN grp a ON a.grp = g1 JOIN grp b ON b.grp = g2 AND a.node <> b.node WHERE whole)"""
PLACED = TURNS + """, ag AS (SELECT s.u, s.v, adamic_adar AS score, least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2 FROM s JOIN grp a ON a.node = s.u JOIN grp b ON b.node = s.v),
pl AS (SELECT ag.*, kappa, sigma, turn, row_number() OVER (PARTITION BY g1, g2 ORDER BY score DESC, u, v) AS r FROM ag JOIN tc USING (g1, g2) WHERE NOT whole)"""


def _filled(placed: str) -> str:
    return f""", rk AS (SELECT u, v, score, CASE WHEN r <= kappa - sigma THEN -1 WHEN r < kappa + sigma THEN 0 ELSE 1 END AS pool, CASE WHEN r <= kappa - sigma THEN turn ELSE 0 END AS turn
                      FROM {placed} WHERE r <= kappa - sigma OR r <= kappa + 3 * sigma
                      UNION ALL SELECT u, v, 'infinity'::DOUBLE, -1, turn FROM wh WHERE NOT EXISTS (SELECT 1 FROM gu WHERE gu.u = wh.u AND gu.v = wh.v)),
out AS MATERIALIZED (SELECT u, v FROM rk ORDER BY pool, turn, score DESC, u, v LIMIT {K})"""


@query(f"{GU}{BINS}, grp AS (SELECT * FROM dg){CELLS} SELECT g1, g2, n, round(p, 9) AS p, kappa, sigma, size FROM cells")
def cell_budgets(spark, sf):
    g = V.part_graph(spark, sf)
    return grouped.cells(g, grouped.degree_groups(g), K).withColumn("p", F.round("p", 9))


@query(f"{WEDGES}{BINS}, grp AS (SELECT * FROM dg){CELLS}{PLACED}{_filled('pl')} SELECT * FROM out")
def grouped_degree(spark, sf):
    g = V.part_graph(spark, sf)
    return grouped.select(g, grouped.degree_groups(g), K)


@query(f"{WEDGES}{BINS}, grp AS (SELECT node, grp * 3 + node % 3 AS grp FROM dg){CELLS}{PLACED}{_filled('pl')} SELECT * FROM out")
def grouped_product(spark, sf):
    g = V.part_graph(spark, sf)
    thirds = g.all_nodes().select("node", F.pmod("node", F.lit(3)).alias("grp"))
    return grouped.select(g, grouped.product_groups((grouped.degree_groups(g), 25), (thirds, 3)), K)


@query(f"""{WEDGES}{BINS}, grp AS (SELECT * FROM dg){CELLS}{PLACED},
la AS (SELECT g1, g2, min(score) AS bar FROM pl WHERE r <= greatest(kappa - sigma, 1) GROUP BY ALL),
te AS (SELECT round(aa, 9) AS score, least(a.grp, b.grp) AS g1, greatest(a.grp, b.grp) AS g2 FROM w JOIN grp a ON a.node = w.u JOIN grp b ON b.node = w.v WHERE EXISTS (SELECT 1 FROM gu WHERE gu.u = w.u AND gu.v = w.v)),
se AS (SELECT g1, g2, count(*) AS seen FROM te JOIN la USING (g1, g2) WHERE score >= bar GROUP BY ALL),
ok AS (SELECT g1, g2 FROM cells LEFT JOIN se USING (g1, g2) WHERE coalesce(seen, 0) / greatest(round_even(round(kappa / {K}::DOUBLE * (SELECT count(*) FROM gu), 9), 0), 1) >= 0.5),
pk AS (SELECT pl.* FROM pl SEMI JOIN ok USING (g1, g2)){_filled('pk')}
SELECT * FROM out UNION ALL (SELECT u, v FROM s WHERE NOT EXISTS (SELECT 1 FROM out WHERE out.u = s.u AND out.v = s.v) ORDER BY adamic_adar DESC, u, v LIMIT (SELECT {K} - count(*) FROM out))""")
def grouped_bailout(spark, sf):
    g = V.part_graph(spark, sf)
    return grouped.select(g, grouped.degree_groups(g), K, bailout=0.5)


VE = "ve AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vec, label FROM embeddings)"
DOT = "round(list_inner_product({a}, {b}), 9)"
DIST = "round(1 - list_inner_product({a}, {b}) / (sqrt(list_inner_product({a}, {a})) * sqrt(list_inner_product({b}, {b}))), 9)"


@query(f"""WITH {VE}, p AS (SELECT a.id AS u, b.id AS v, a.label AS grp, {DIST.format(a='a.vec', b='b.vec')} AS distance FROM ve a JOIN ve b ON a.label = b.label AND a.id < b.id)
SELECT u, v, grp, distance FROM p QUALIFY row_number() OVER (PARTITION BY grp ORDER BY distance, u, v) <= 20""")
def cell_exact_cosine(spark, sf):
    e = V.vectors(spark, sf)
    groups = e.select(F.col("id").alias("node"), F.col("label").alias("grp"))
    wanted = groups.select(F.col("grp").alias("g1"), F.col("grp").alias("g2")).distinct()
    return grouped.first_vector_pairs(e, groups, wanted, 20).select("u", "v", F.col("g1").cast("int").alias("grp"), (-F.col("score")).alias("distance"))


CODES = f"""WITH {VE}, pn AS (SELECT t AS tree, l AS level, list(CASE WHEN ('0x' || substr(md5(concat_ws('|', '42', t, l, i)), 1, 1))::INT < 8 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END ORDER BY i) AS plane
       FROM range(4) a(t), range(6) b(l), range(64) c(i) GROUP BY ALL),
cd AS (SELECT id, tree, string_agg(CASE WHEN list_inner_product(plane, vec) >= 0 THEN '1' ELSE '0' END, '' ORDER BY level) AS leaf FROM ve, pn GROUP BY ALL)"""


@query(f"{CODES} SELECT id, tree, leaf FROM cd")
def hash_codes(spark, sf):
    return lsh.codes(V.vectors(spark, sf), 4, 6)


@query(f"{CODES}, p AS (SELECT DISTINCT a.id AS u, b.id AS v FROM cd a JOIN cd b USING (tree, leaf) WHERE a.id < b.id) SELECT u, v, {DIST.format(a='x.vec', b='y.vec')} AS distance FROM p JOIN ve x ON x.id = u JOIN ve y ON y.id = v ORDER BY distance, u, v LIMIT 1000")
def hash_pairs(spark, sf):
    e = V.vectors(spark, sf)
    return lsh.pairs(e, lsh.codes(e, 4, 6), 1000)


START = f"""WITH {VE}, ids AS (SELECT id, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS n FROM ve),
dr AS (SELECT DISTINCT x.id AS v, y.id AS u FROM ids x CROSS JOIN range(5) r(i) JOIN ids y ON y.pos = ('0x' || substr(md5(concat_ws('|', '42', x.id, i)), 1, 7))::BIGINT % x.n + 1 WHERE x.id <> y.id),
k0 AS MATERIALIZED (SELECT v, u, {DOT.format(a='a.vec', b='b.vec')} AS score, true AS fresh FROM dr JOIN ve a ON a.id = v JOIN ve b ON b.id = u)"""


def _simple_sql(rounds: int) -> str:
    sql = START
    for i in range(1, rounds + 1):
        k = f"k{i - 1}"
        sql += f""", f{i} AS (SELECT DISTINCT a.v, b.u FROM {k} a JOIN {k} b ON a.u = b.v WHERE a.v <> b.u AND NOT EXISTS (SELECT 1 FROM {k} z WHERE z.v = a.v AND z.u = b.u)),
k{i} AS MATERIALIZED (SELECT * FROM (SELECT v, u, score FROM {k} UNION ALL SELECT v, u, {DOT.format(a='a.vec', b='b.vec')} FROM f{i} JOIN ve a ON a.id = v JOIN ve b ON b.id = u) QUALIFY row_number() OVER (PARTITION BY v ORDER BY score DESC, u) <= 5)"""
    return f"{sql} SELECT v, u, score FROM k{rounds}"


@query(_simple_sql(3))
def knn_simple(spark, sf):
    return knn.simple(V.vectors(spark, sf), 5, 3, fixed=True)


def _descent_sql(rounds: int, reverse: bool = False) -> str:
    sql, bar = START, f"{int(0.5 * 0xFFFFFFF):07x}"
    for i in range(1, rounds + 1):
        k = f"k{i - 1}"
        sql += f""", m{i} AS MATERIALIZED (SELECT *, fresh AND substr(md5(concat_ws('|', '42', v, u, {i - 1})), 1, 7) < '{bar}' AS drawn FROM {k}),
mm{i} AS ({f"SELECT v, u, bool_or(drawn) AS drawn, bool_or(fresh) AS fresh FROM (SELECT v, u, drawn, fresh FROM m{i} UNION ALL SELECT u, v, drawn, fresh FROM m{i}) GROUP BY ALL" if reverse else f"SELECT * FROM m{i}"}),
j{i} AS (SELECT DISTINCT least(a.u, b.u) AS a, greatest(a.u, b.u) AS b FROM mm{i} a JOIN mm{i} b ON a.v = b.v WHERE a.drawn AND (b.drawn OR NOT b.fresh) AND a.u <> b.u AND (NOT b.drawn OR a.u < b.u)),
o{i} AS (SELECT a, b, {DOT.format(a='x.vec', b='y.vec')} AS score FROM j{i} JOIN ve x ON x.id = a JOIN ve y ON y.id = b),
n{i} AS (SELECT a AS v, b AS u, score FROM o{i} UNION ALL SELECT b, a, score FROM o{i}),
k{i} AS MATERIALIZED (SELECT * FROM (SELECT v, u, score, fresh AND NOT drawn AS fresh FROM m{i} UNION ALL SELECT v, u, score, true FROM n{i} WHERE NOT EXISTS (SELECT 1 FROM {k} z WHERE z.v = n{i}.v AND z.u = n{i}.u)) QUALIFY row_number() OVER (PARTITION BY v ORDER BY score DESC, u) <= 5)"""
    return f"{sql} SELECT v, u, score FROM k{rounds}"


@query(_descent_sql(3))
def knn_descent(spark, sf):
    return knn.descent(V.vectors(spark, sf), 5, 3, fixed=True)


@query(_descent_sql(2, True))
def knn_descent_reverse(spark, sf):
    return knn.descent(V.vectors(spark, sf), 5, 2, fixed=True, reverse=True)


# the selectors with their own defaults and stopping rules, which SQL of a fixed length cannot say


@query()
def knn_simple_full(spark, sf):
    return knn.simple(V.vectors(spark, sf), 5)


@query()
def knn_descent_full(spark, sf):
    return knn.descent(V.vectors(spark, sf), 5)


@query()
def hash_codes_full(spark, sf):
    return lsh.codes(V.vectors(spark, sf))


@query()
def hash_pairs_full(spark, sf):
    e = V.vectors(spark, sf)
    return lsh.pairs(e, lsh.codes(e), 1000)


EVERY = f"WITH {VE}, ex AS (SELECT a.id AS u, b.id AS v, {DOT.format(a='a.vec', b='b.vec')} AS score, a.label = b.label AS same FROM ve a JOIN ve b ON a.id < b.id)"


@query(f"{EVERY} SELECT u, v, score FROM ex")
def exhaustive_pairs(spark, sf):
    return knn.exhaustive(V.vectors(spark, sf))


@query(f"{EVERY} SELECT count(*) AS n_pairs, count(*) FILTER (score > 0.9) AS n_sure, count(*) FILTER (score > 0.5) AS n_likely FROM ex")
def exhaustive_confidence(spark, sf):
    return knn.count_above(V.vectors(spark, sf), {"n_sure": 0.9, "n_likely": 0.5})


def _next_pairs(e):
    return e.select(F.col("id").alias("u"), (F.col("id") + 1).alias("v")).join(e.select(F.col("id").alias("v")), "v", "left_semi").select("u", "v")


@query(f"WITH {VE} SELECT a.id AS u, b.id AS v, round(list_inner_product(a.vec, b.vec), 9) AS total, round(a.vec[1] * b.vec[1], 9) AS head FROM ve a JOIN ve b ON b.id = a.id + 1")
def pair_features(spark, sf):
    e = V.vectors(spark, sf)
    f = models.pair_features(_next_pairs(e), e)
    return f.select("u", "v", F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 9).alias("total"), F.round(F.col("features")[0], 9).alias("head"))


def _labelled(e):
    """Every pair with its score and the labels lu and lv."""
    return knn.exhaustive(e, more=("label", "lu", "lv"))


@query(f"{EVERY} SELECT u, v, CASE WHEN same THEN 1.0 ELSE round(1 / (1 + exp(-score)), 9) END::DOUBLE AS p FROM ex")
def oracle_perfect(spark, sf):
    every = _labelled(V.vectors(spark, sf))
    asked = every.select("u", "v", "lu", "lv", F.round(1 / (1 + F.exp(-F.col("score"))), 9).alias("p"))
    return models.with_truth(asked, F.col("lu") == F.col("lv"))


@query(f"""{EVERY}, c AS (SELECT sum(same::INT) AS pos, sum((score > 0.1)::INT) AS said, sum((same AND score > 0.1)::INT) AS tp, count(*) AS n FROM ex)
SELECT round((tp / pos) * CASE WHEN said > 0 THEN tp / said ELSE 0 END + (1 - tp / pos) * pos / n, 9) AS average_precision FROM c""")
def average_precision(spark, sf):
    x = _labelled(V.vectors(spark, sf))
    return metrics.hard_average_precision(x.select((F.col("lu") == F.col("lv")).cast("long").alias("y"), (F.col("score") > 0.1).cast("long").alias("yhat")))


@query(f"""WITH {VE}, c AS (SELECT id AS cluster, vec AS centre FROM ve QUALIFY row_number() OVER (PARTITION BY label ORDER BY id) = 1),
d AS (SELECT ve.id, cluster, round(list_sum(list_transform(list_zip(vec, centre), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 9) AS d FROM ve, c)
SELECT id, cluster FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, cluster) = 1""")
def kmeans_assign(spark, sf):
    e = V.vectors(spark, sf)
    return models.assign(e, G.ranked(e, ["label"], "id").where("rk = 1").select(F.col("id").alias("cluster"), F.col("vec").alias("centre")))


@query()
def kmeans_fit(spark, sf):
    return models.kmeans(V.vectors(spark, sf), 10)


@query()
def logistic_scores(spark, sf):
    e = V.vectors(spark, sf)
    vectors = held.hold(e, "label")
    if vectors is not None and vectors.known.all() and len(vectors.ids) > 1:
        shared = spark.sparkContext.broadcast(vectors)
        return links.probabilities(spark, shared, links.fit(links.draw(spark, shared, 42), shared, (0.1, 1.0))[0])
    x = knn.exhaustive(e).join(e.select(F.col("id").alias("u"), F.col("label").alias("lu")), "u").join(e.select(F.col("id").alias("v"), F.col("label").alias("lv")), "v")
    rows = x.select("u", "v", (F.col("lu") == F.col("lv")).cast("int").alias("y"), digest(42, "u", "v").alias("d"))
    fit = models.pair_features(rows.where("d < '2'"), e)
    valid = models.pair_features(rows.where("d >= 'e'"), e)
    model, _ = models.fit_links(fit, valid, (0.1, 1.0), 50)
    return models.link_probability(model, rows.select("u", "v"), e)


@query("WITH " + VE + """, f AS (SELECT id AS node, unnest(range(64)) AS c, unnest(vec) AS f FROM ve), t AS (SELECT c, max(f) AS top FROM f GROUP BY c),
l AS (SELECT f.* FROM f JOIN t USING (c) WHERE f > 0 AND f * top >= 3.2::DOUBLE / 64)
SELECT a.node AS u, b.node AS v, round(sum(a.f * b.f), 9) AS score FROM l a JOIN l b ON a.c = b.c AND a.node < b.node AND a.f * b.f >= 3.2::DOUBLE / 64 GROUP BY ALL""")
def factor_pairs(spark, sf):
    f = V.vectors(spark, sf).select(F.col("id").alias("node"), F.posexplode("vec").alias("c", "f"))
    return models.factor_pairs(f, 3.2)


@query(f"""{WEDGES}, p AS (SELECT u, v, jaccard AS score FROM s UNION ALL SELECT u, v, round(adamic_adar / 10, 9) FROM s), b AS (SELECT u, v, max(score) AS score FROM p GROUP BY ALL)
SELECT u, v, score FROM b ORDER BY score DESC, u, v LIMIT 1000""")
def ensemble_union(spark, sf):
    s = scores.wedge_scores(V.part_graph(spark, sf))
    return models.union_best([s.select("u", "v", F.col("jaccard").alias("score")), s.select("u", "v", F.round(F.col("adamic_adar") / 10, 9).alias("score"))], 1000)


@query()
def nmf_ensemble(spark, sf):
    return models.nmf_ensemble(V.part_graph(spark, sf), 500, bags=9, rank=50)


FEATURES = f"{_layers_sql(2)}, sf AS (SELECT q AS node, deg AS d, round(sum(pow(0.1, hop)), 9) AS x FROM s2 JOIN deg ON deg.node = s2.v GROUP BY ALL)"


def _features(spark, sf):
    g = V.part_graph(spark, sf)
    return models.structure_features(g, search.layers(g, g.all_nodes(), 2))


@query(f"{FEATURES} SELECT node, d, x FROM sf")
def structure_features(spark, sf):
    return _features(spark, sf)


@query(f"""{FEATURES}, lm AS (SELECT q AS landmark FROM src0 ORDER BY md5(concat_ws('|', '42', q)), q LIMIT (SELECT least(floor(10 * log2(count(*)))::BIGINT, count(*)) FROM src0)), ds AS (SELECT DISTINCT d FROM sf),
g AS (SELECT n.node, lm.landmark, sum(pow(coalesce(a.x, 0) - coalesce(b.x, 0), 2)) AS gap FROM (SELECT DISTINCT node FROM sf) n CROSS JOIN lm CROSS JOIN ds LEFT JOIN sf a ON a.node = n.node AND a.d = ds.d LEFT JOIN sf b ON b.node = lm.landmark AND b.d = ds.d GROUP BY ALL)
SELECT node, landmark, round(exp(-sqrt(round(gap, 9))), 9) AS sim FROM g""")
def landmark_similarity(spark, sf):
    return shapes.landmark_similarity(V.part_graph(spark, sf))


@query()
def structure_embedding(spark, sf):
    return shapes.structure_embedding(V.part_graph(spark, sf))


@query()
def factor_embedding(spark, sf):
    return models.factor_embedding(V.part_graph(spark, sf), 8)


def _hits_sql(rounds: int) -> str:
    sql = f"WITH {V.PURCHASE_ADJ}, h0 AS (SELECT node, 1.0::DOUBLE AS a FROM deg)"
    for i in range(1, rounds + 1):
        sql += f", x{i} AS (SELECT src AS node, sum(a) AS a FROM adj JOIN h{i - 1} ON node = dst GROUP BY src), h{i} AS MATERIALIZED (SELECT node, a / (SELECT sum(a) FROM x{i}) AS a FROM x{i})"
    return sql


@query(f"{_hits_sql(4)} SELECT node, round(a, 9) AS authority FROM h4")
def hits_authority(spark, sf):
    return models.hits(V.purchase_graph(spark, sf), 4).withColumn("authority", F.round("authority", 9))


COUNTS = f"WITH {V.PURCHASE_ADJ}, ce AS (SELECT node, deg / ((SELECT count(*) FROM deg) - 1) AS a FROM deg), mm AS (SELECT node % 2 AS side, min(a) AS lo, max(a) AS hi FROM ce GROUP BY 1), wc AS (SELECT node, greatest(ceil(round(CASE WHEN hi > lo THEN (a - lo) / (hi - lo) ELSE 0 END * 32, 6)), 1)::BIGINT AS walks FROM ce JOIN mm ON side = node % 2)"


@query(f"{COUNTS} SELECT node, walks FROM wc")
def walk_counts(spark, sf):
    return models.walk_counts(models.side_scaled(models.degree_centrality(V.purchase_graph(spark, sf))))


def _corpus_sql(steps: int) -> str:
    h = lambda s, what: f"('0x' || substr(md5(concat_ws('|', '42', node, walk, {s}, '{what}')), 1, 7))::BIGINT"
    sql = f"{COUNTS}, {SOURCES}, nb AS (SELECT a.*, deg, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS i FROM adj a JOIN deg ON node = src), st AS (SELECT wc.* FROM wc JOIN src0 ON q = node), y0 AS (SELECT node, unnest(range(1, walks + 1)) AS walk, node AS loc FROM st)"
    for s in range(1, steps + 1):
        sql += f", z{s} AS (SELECT node, walk, dst AS loc FROM y{s - 1} JOIN nb ON src = loc AND i = {h(s, 'one')} % deg WHERE {h(s, 'stop')} >= {int(0.15 * (1 << 28))}), y{s} AS MATERIALIZED (SELECT node, walk, dst AS loc FROM z{s} JOIN nb ON src = loc AND i = {h(s, 'two')} % deg)"
    return sql + ", co AS (" + " UNION ALL ".join(f"SELECT node, walk, {s} AS pos, loc FROM y{s}" for s in range(steps + 1)) + ")"


def _corpus(spark, sf):
    g = V.purchase_graph(spark, sf)
    counts = models.walk_counts(models.side_scaled(models.degree_centrality(g)))
    return g, models.walk_corpus(g, counts, 4)


@query(f"{_corpus_sql(4)} SELECT node, walk, pos, loc AS at FROM co")
def walk_corpus(spark, sf):
    return _corpus(spark, sf)[1].select("node", F.col("walk").cast("long").alias("walk"), F.col("pos").cast("int").alias("pos"), "at")


@query(f"""{_corpus_sql(4)} SELECT a.node, a.walk, a.pos, a.loc AS at, coalesce(string_agg(b.loc::VARCHAR, ' ' ORDER BY b.pos) FILTER (b.loc <> a.loc), '') AS context
FROM co a JOIN co b ON a.node = b.node AND a.walk = b.walk AND abs(a.pos - b.pos) <= 2 GROUP BY a.node, a.walk, a.pos, a.loc""")
def context_windows(spark, sf):
    w = models.context_windows(_corpus(spark, sf)[1], 2)
    return w.select("node", F.col("walk").cast("long").alias("walk"), F.col("pos").cast("int").alias("pos"), "at", F.array_join(F.transform("context", lambda x: x.cast("string")), " ").alias("context"))


@query()
def skipgram_embedding(spark, sf):
    g, walks = _corpus(spark, sf)
    return models.skipgram_embedding(g, walks, dim=8, epochs=2)[0]


@query(f"""WITH {V.PURCHASES}, st AS (SELECT DISTINCT u AS item, v AS member FROM gb), sz AS (SELECT item, count(*) AS n FROM st GROUP BY item), it AS (SELECT item, n, row_number() OVER (ORDER BY item) AS pos, count(*) OVER () AS total FROM sz),
dr AS (SELECT x.item, y.item AS other, x.n, y.n AS m, min(i) AS i FROM it x CROSS JOIN range(30) r(i) JOIN it y ON y.pos = ('0x' || substr(md5(concat_ws('|', '42', x.item, i)), 1, 7))::BIGINT % x.total + 1 WHERE x.item <> y.item GROUP BY ALL),
cm AS (SELECT dr.item, dr.other, count(*) AS c FROM dr JOIN st a ON a.item = dr.item JOIN st b ON b.item = dr.other AND b.member = a.member GROUP BY ALL)
SELECT item, other FROM dr LEFT JOIN cm USING (item, other) WHERE coalesce(c, 0) / (n + m - coalesce(c, 0)) <= 0.6 QUALIFY row_number() OVER (PARTITION BY item ORDER BY i, other) <= 3""")
def jaccard_negatives(spark, sf):
    return lsh.jaccard_negatives(V.purchases(spark, sf).select(F.col("u").alias("item"), F.col("v").alias("member")).distinct())


TRAIN = f"""WITH {V.SHARED_ORDERS.split('adj AS')[0].rstrip().rstrip(',').replace('gu AS', 'gall AS')}, {TEMPORAL.replace('FROM gu', 'FROM gall')},
gu AS (SELECT u, v FROM sp WHERE part <> 'test'), hid AS (SELECT u, v FROM sp WHERE part = 'test'),
adj AS (SELECT u AS src, v AS dst FROM gu UNION ALL SELECT v, u FROM gu), deg AS (SELECT src AS node, count(*) AS deg FROM adj GROUP BY src), {WEDGES.split(', w AS', 1)[1].join(['w AS', ''])}"""
CURVE = TRAIN + """, ln AS (SELECT u, v, 'adamic_adar' AS method, adamic_adar AS score FROM s UNION ALL SELECT u, v, 'common', common FROM s UNION ALL SELECT u, v, 'jaccard', jaccard FROM s),
ra AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, u, v) AS rk FROM ln), nh AS (SELECT count(*) AS n FROM hid),
cu AS (SELECT method, h, ra.u, ra.v FROM ra, nh, range(1, 6) r(h) WHERE rk <= h * nh.n), nn AS (SELECT count(DISTINCT x)::DOUBLE AS n FROM (SELECT u AS x FROM gall UNION ALL SELECT v FROM gall)),
me AS (SELECT method, h, count(hid.u) AS n_found, count(*) AS n_predicted FROM cu LEFT JOIN hid ON hid.u = cu.u AND hid.v = cu.v GROUP BY ALL)
SELECT method, h, n_found, n_predicted, nh.n AS n_hidden, n_found / nh.n AS recall, n_found / n_predicted AS precision, n_predicted / (nn.n * nn.n) AS scan_rate, CASE WHEN n_found > 0 THEN n_predicted / n_found ELSE 0 END::DOUBLE AS scans_per_found_edge FROM me, nh, nn"""


@query(CURVE)
def recall_curve(spark, sf):
    g = V.part_graph(spark, sf)
    split = cut(splits.temporal_split(g.edges))
    hidden = split.where("part = 'test'").select("u", "v")
    n_hidden = hidden.count()
    s = cut(scores.wedge_scores(G.Graph(cut(splits.train_graph(split)))))
    best = None
    for m in ("adamic_adar", "common", "jaccard"):
        rows = scores.top_pairs(s, m, 5 * n_hidden).select("u", "v", F.lit(m).alias("method"), F.col(m).cast("double").alias("score"))
        best = rows if best is None else best.unionByName(rows)
    r = G.ranked(best, ["method"], F.desc("score"), "u", "v")
    budgets = r.withColumn("h", F.explode(F.sequence(F.ceil(F.col("rk") / n_hidden), F.lit(5).cast("long"))))
    return metrics.benchmark_metrics(budgets.select("method", "h", "u", "v"), hidden, g.size()[0], ["method", "h"])


#: Run records made of the orders: dataset by priority, method by status, h and figures by key.
RUNS = "rn AS (SELECT o_orderpriority AS dataset, o_orderstatus AS method, (o_orderkey % 10 + 1)::INT AS h, o_orderkey AS seq, round((o_custkey % 997) / 1000.0::DOUBLE, 3) AS recall, ((o_orderkey * 7919) % 500 + 0.27)::DOUBLE AS time, (o_orderkey % 5)::DOUBLE AS scans_per_found_edge FROM orders), fr AS (SELECT * FROM rn QUALIFY row_number() OVER (PARTITION BY dataset, method, h ORDER BY seq) = 1)"


def _runs(spark, sf):
    o = V.read(spark, sf, "orders")
    return o.select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("method"), (F.col("o_orderkey") % 10 + 1).cast("int").alias("h"), F.col("o_orderkey").alias("seq"),
        F.round((F.col("o_custkey") % 997) / 1000.0, 3).alias("recall"), ((F.col("o_orderkey") * 7919) % 500 + 0.27).cast("double").alias("time"), (F.col("o_orderkey") % 5).cast("double").alias("scans_per_found_edge"),
    )


_cell = lambda m, h: f"coalesce(max(format('{{:.1f}}', time)) FILTER (method = '{m}' AND h = {h}), 'XX') AS {m}_h{h}"


@query(f"WITH {RUNS} SELECT dataset, " + ", ".join(_cell(m, h) for m in "FOP" for h in (1, 10)) + " FROM fr GROUP BY dataset")
def time_table(spark, sf):
    return metrics.time_table(_runs(spark, sf), ["F", "O", "P"])


AVERAGE = f"WITH {RUNS}, av AS (SELECT dataset, method, round(sum(recall) / 10, 9) AS avg_recall FROM fr GROUP BY ALL), bo AS (SELECT *, lead(avg_recall) OVER w AS second, row_number() OVER w AS r FROM av WINDOW w AS (PARTITION BY dataset ORDER BY avg_recall DESC, method)), be AS (SELECT dataset, method AS best, avg_recall, CASE WHEN avg_recall > 0 THEN round((avg_recall - coalesce(second, 0)) / avg_recall, 9) ELSE 0 END::DOUBLE AS gap FROM bo WHERE r = 1)"


@query(f"{AVERAGE} SELECT * FROM av")
def average_recall(spark, sf):
    return metrics.average_recall(_runs(spark, sf))


@query(f"{AVERAGE} SELECT * FROM be")
def best_method(spark, sf):
    return metrics.best_methods(_runs(spark, sf))


@query(f"{AVERAGE} SELECT best, count(*) AS wins FROM be GROUP BY best")
def win_counts(spark, sf):
    return metrics.win_counts(_runs(spark, sf))


@query(f"WITH {RUNS} SELECT method, h AS x, round(avg(recall), 9) AS y FROM rn GROUP BY ALL")
def mean_by_h(spark, sf):
    return metrics.mean_by(_runs(spark, sf), "h", "recall")


@query(f"WITH {RUNS} SELECT dataset, method, h, seq, CASE WHEN scans_per_found_edge > 0 THEN round(1 / scans_per_found_edge, 9) ELSE 0 END::DOUBLE AS tplp FROM rn WHERE method IN ('F', 'O')")
def found_share(spark, sf):
    return metrics.found_share(metrics.filter_runs(_runs(spark, sf), ["F", "O"])).select("dataset", "method", "h", "seq", "tplp")


@query(f"""WITH {V.PURCHASES}, ra AS (SELECT u AS user, v AS item, row_number() OVER (PARTITION BY u ORDER BY md5(concat_ws('|', '42', u, v)), v) AS rk FROM gb), re AS (SELECT u AS user, v AS item FROM gb WHERE ts >= DATE '1997-01-01'),
hi AS (SELECT ra.*, (re.item IS NOT NULL)::INT AS rel FROM ra LEFT JOIN re USING (user, item) WHERE rk <= 10), so AS (SELECT *, sum(rel) OVER (PARTITION BY user ORDER BY rk) AS so_far FROM hi),
pe AS (SELECT user, sum(rel) AS found, sum(rel * so_far / rk) AS ap, max(CASE WHEN rel = 1 THEN 1 / rk ELSE 0 END) AS rr, sum(rel / log2(rk + 1)) AS dcg FROM so GROUP BY user), wa AS (SELECT user, count(*) AS wanted, least(count(*), 10) AS most FROM re GROUP BY user)
SELECT user, round(coalesce(found / 10, 0), 9) AS precision, round(coalesce(found / wanted, 0), 9) AS recall, round(coalesce(ap / most, 0), 9) AS ap, round(coalesce(rr, 0), 9) AS rr, round(coalesce(dcg / list_sum(list_transform(range(1, most + 1), lambda i: 1 / log2(i + 1))), 0), 9) AS ndcg FROM wa LEFT JOIN pe USING (user)""")
def ranking_metrics(spark, sf):
    p = V.purchases(spark, sf).select(F.col("u").alias("user"), F.col("v").alias("item"), "ts")
    ranked = G.ranked(p.drop("ts"), ["user"], digest(42, "user", "item"), "item")
    return metrics.ranking_metrics(ranked, p.where("ts >= date '1997-01-01'").drop("ts"), 10)


@query(f"WITH {RUNS} SELECT '2024-01-01' AS date, method, dataset, h, recall, time, h::VARCHAR AS p_h FROM rn")
def run_json_roundtrip(spark, sf):
    r = _runs(spark, sf).select(F.lit("2024-01-01").alias("date"), "method", "dataset", "h", F.struct("recall", "time").alias("statistics"), F.create_map(F.lit("h"), F.col("h").cast("string")).alias("parameters"))
    back = files.runs(spark, files.run_lines(r))
    return back.select("date", "method", "dataset", "h", "statistics.recall", "statistics.time", F.col("parameters")["h"].alias("p_h"))


@query(f"{GU} SELECT least(u::VARCHAR, v::VARCHAR) AS u, greatest(u::VARCHAR, v::VARCHAR) AS v FROM gu")
def edge_text_parse(spark, sf):
    e = V.shared_orders(spark, sf)
    text = F.concat(F.col("v").cast("string"), F.lit("  "), F.col("u").cast("string"))
    lines = e.select(F.explode(F.array(F.concat(F.lit("# "), text), F.concat(F.lit(" "), text), text)).alias("value"))  # comments and repeats
    return files.edges(spark, lines)


@query(f"{GU}, o AS (SELECT u, v, row_number() OVER (ORDER BY ts, u, v) AS rn, {SIZES} FROM gu) SELECT u, v, {PARTS} FROM o")
def file_order_split(spark, sf):
    rows = row_numbers(V.part_graph(spark, sf).edges.select("u", "v", "ts"), "ts", "u", "v")
    return splits.file_order_split(rows)
