"""Link classifiers, clustering and embeddings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgesmith.functions.lineage import cut, forget, row_numbers, stored
from edgesmith.functions.portable import digest, hadamard
from edgesmith.operators.graph import Graph, degrees
from edgesmith.operators.metrics import hard_average_precision


#: Most centres and landmarks that every task holds.
CENTRES = 10_000


def pair_features(pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """pairs with ``features``, the product of the two vectors entry by entry."""
    x, y = (emb.select(F.col("id").alias(c), F.col("vec").alias(f"_{c}")) for c in ("u", "v"))
    return pairs.join(x, "u").join(y, "v").withColumn("features", hadamard(F.col("_u"), F.col("_v"))).drop("_u", "_v")


def fit_links(train: DataFrame, valid: DataFrame, grid: tuple[float, ...] = (0.01, 0.05, 0.1, 0.5, 1.0), max_iter: int = 300) -> tuple[LogisticRegressionModel, float]:
    """Ridge logistic model over (features, y) with the C of the grid that has the best hard average precision."""
    ready = lambda d: d.select(array_to_vector("features").alias("features"), F.col("y").cast("double").alias("label"))
    fit, held = cut(ready(train)), cut(ready(valid))
    n, best = fit.count(), (None, -1.0)
    for c in grid:
        model = LogisticRegression(elasticNetParam=0.0, standardization=False, regParam=1.0 / (c * n), maxIter=max_iter).fit(fit)
        said = model.transform(held).select(F.col("label").alias("y"), F.col("prediction").alias("yhat"))
        score = hard_average_precision(said).first()[0] or 0.0
        if score > best[1]:
            best = (model, score)
    return best


def link_probability(model: LogisticRegressionModel, pairs: DataFrame, emb: DataFrame) -> DataFrame:
    """(u, v, p)."""
    made = model.transform(pair_features(pairs, emb).withColumn("features", array_to_vector("features")))
    return made.select("u", "v", F.element_at(vector_to_array("probability"), 2).alias("p"))


def with_truth(scored: DataFrame, hidden: DataFrame | Column) -> DataFrame:
    """(u, v, p) where known hidden pairs, a table or what is true of them, have probability 1."""
    if isinstance(hidden, DataFrame):
        scored, hidden = scored.join(hidden.select("u", "v", F.lit(True).alias("known")), ["u", "v"], "left"), F.col("known")
    return scored.select("u", "v", F.when(hidden, 1.0).otherwise(F.col("p")).alias("p"))


def assign(emb: DataFrame, centres: DataFrame) -> DataFrame:
    """(id, cluster): nearest centre of (cluster, centre), ties to the smaller. Every row meets every centre, so these are
    counted first: more than CENTRES of them is not what k-means is for."""
    if centres.count() > CENTRES:
        raise ValueError(f"more than {CENTRES} centres")
    both = emb.select("id", "vec").join(F.broadcast(centres))
    d = F.aggregate(F.zip_with("vec", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return both.groupBy("id").agg(F.min(F.struct(F.round(d, 9).alias("d"), "cluster"))["cluster"].alias("cluster"))


def kmeans(emb: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(id, cluster)."""
    ready = cut(emb.select("id", array_to_vector("vec").alias("features")))
    return KMeans(k=k, seed=seed, featuresCol="features").fit(ready).transform(ready).select("id", F.col("prediction").cast("long").alias("cluster"))


def structure_features(graph: Graph, layers: DataFrame, alpha: float = 0.1, log_base: float | None = None) -> DataFrame:
    """(node, d, x): degree histogram of the nodes around each node, discounted by alpha for each hop; with
    ``log_base`` d is the floor of the degree's logarithm."""
    deg = degrees(graph.adj)
    d = F.col("deg") if log_base is None else F.floor(F.log(log_base, F.col("deg").cast("double")) + 1e-9)
    near = layers.join(deg.withColumnRenamed("node", "v"), "v")
    return near.groupBy(F.col("q").alias("node"), d.alias("d")).agg(F.round(F.sum(F.pow(F.lit(alpha), F.col("hop"))), 9).alias("x"))


def landmark_similarity(features: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(node, landmark, sim): exp of minus the distance of sparse feature vectors.

    |a - b|^2 = |a|^2 + |b|^2 - 2 a.b, so only shared entries are joined; landmarks are few by their sample, and counted.
    """
    if landmarks.count() > CENTRES:
        raise ValueError(f"more than {CENTRES} landmarks")
    marks = features.join(landmarks.select("node"), "node", "left_semi").select(F.col("node").alias("landmark"), "d", F.col("x").alias("y"))
    size = features.groupBy("node").agg(F.sum(F.col("x") * F.col("x")).alias("xx"))
    msize = marks.groupBy("landmark").agg(F.sum(F.col("y") * F.col("y")).alias("yy"))
    both = features.join(marks, "d").groupBy("node", "landmark").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    every = size.join(F.broadcast(msize)).join(both, ["node", "landmark"], "left")
    gap = F.greatest(F.col("xx") + F.col("yy") - 2 * F.coalesce("xy", F.lit(0.0)), F.lit(0.0))
    return every.select("node", "landmark", F.round(F.exp(-F.sqrt(F.round(gap, 9))), 9).alias("sim"))


def landmark_square(w: np.ndarray) -> np.ndarray:
    """What similarities are multiplied by: the root of the inverse of the landmarks' own."""
    u, s, _ = np.linalg.svd(np.linalg.pinv(w))
    return u * np.sqrt(s)


def onto_landmarks(similarity: np.ndarray, square: np.ndarray) -> np.ndarray:
    made = similarity @ square
    length = np.linalg.norm(made, axis=1, keepdims=True)
    return made / np.where(length > 0, length, 1.0)


def structure_embedding(similarity: DataFrame, marks: list) -> DataFrame:
    """(id, vec) from (node, landmark, sim): the landmarks' own square is factored on the driver (it has their
    number squared entries), and every row is multiplied by it."""
    place = {m: i for i, m in enumerate(marks)}
    p = len(marks)
    w = np.zeros((p, p))
    for r in similarity.where(F.col("node").isin(marks)).collect():
        w[place[r["node"]], place[r["landmark"]]] = r["sim"]
    square = landmark_square(w)
    row = F.transform(F.array_sort(F.collect_list(F.struct("landmark", "sim"))), lambda x: x["sim"])
    rows = similarity.groupBy(F.col("node").alias("id")).agg(row.alias("c"))

    def multiply(batches):
        for pdf in batches:
            yield pdf[["id"]].assign(vec=list(onto_landmarks(np.stack(pdf["c"].to_numpy()) if len(pdf) else np.zeros((0, p)), square)))

    return rows.mapInPandas(multiply, "id long, vec array<double>")


def factor_embedding(graph: Graph, dim: int = 16, window: int = 2, negative: int = 1, held: int = 1 << 25, edges: int = 1 << 24) -> DataFrame:
    """(id, vec): singular vectors of log(max(1, vol / (negative * window) * sum of walk steps * D^-1)).

    Up to ``held`` entries of the basis (nodes times dimensions, counted) tasks multiply their rows of the matrix by it; beyond, the
    decomposition is Lanczos on the Gram matrix. A graph of at most ``edges`` directed edges goes to every task, which makes its rows
    whenever they are multiplied, so none is written; beyond, the matrix is made by joins, as sparse rows.
    """
    from edgesmith.operators import walkrank

    if small := walkrank._held(graph.edges, edges):
        h = small.value
        n, width = len(h.nodes), min(dim + 8, len(h.nodes))
        if n * width <= held:
            vec = _leading(graph.edges.sparkSession, _own_rows(small, window, negative), n, min(dim, n), width)
            return graph.edges.sparkSession.createDataFrame(pa.table({"id": h.nodes, "vec": _lists(vec)}), "id long, vec array<double>")
    deg = graph.degree
    ids = cut(row_numbers(deg, "node").select("node", "deg", (F.col("rn") - 1).alias("pos")))
    n, volume = ids.count(), ids.agg(F.sum("deg")).first()[0]
    adj = graph.adj.join(ids.select(F.col("node").alias("src"), F.col("pos").alias("i"), "deg"), "src").join(ids.select(F.col("node").alias("dst"), F.col("pos").alias("j")), "dst").select("i", "j", (1 / F.col("deg")).alias("x"))
    adj = cut(adj)
    power, total = adj, adj
    for _ in range(window - 1):
        power = cut(power.select("i", F.col("j").alias("k"), F.col("x").alias("a")).join(adj.select(F.col("i").alias("k"), "j", F.col("x").alias("b")), "k").groupBy("i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("x")))
        total = total.unionByName(power)
    scaled = total.groupBy("i", "j").agg(F.sum("x").alias("x")).join(ids.select(F.col("pos").alias("j"), "deg"), "j")
    m = scaled.select("i", "j", F.log(F.greatest(F.lit(float(volume) / (negative * window)) * F.col("x") / F.col("deg"), F.lit(1.0))).alias("x")).where("x > 0")
    rows = cut(m.groupBy("i").agg(F.collect_list("j").alias("j"), F.collect_list("x").alias("x")))
    width = min(dim + 8, n)
    if n * width <= held:
        vec = _leading(graph.edges.sparkSession, _made_rows(rows), n, min(dim, n), width)
        made = graph.edges.sparkSession.createDataFrame(pa.table({"pos": np.arange(n), "vec": _lists(vec)}))
        return made.join(ids, "pos").select(F.col("node").alias("id"), "vec")
    from pyspark.mllib.linalg import SparseVector
    from pyspark.mllib.linalg.distributed import IndexedRow, IndexedRowMatrix

    matrix = IndexedRowMatrix(rows.rdd.map(lambda r: IndexedRow(r["i"], SparseVector(n, sorted(zip(r["j"], r["x"], strict=True))))), n, n)
    svd = matrix.computeSVD(min(dim, n - 1), computeU=True)
    root = [float(x) ** 0.5 for x in svd.s]
    made = svd.U.rows.map(lambda r: (int(r.index), [float(a) * b for a, b in zip(r.vector, root, strict=True)])).toDF("pos long, vec array<double>")
    return made.join(ids, "pos").select(F.col("node").alias("id"), "vec")


def _lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), np.ascontiguousarray(rows, float).ravel())


def _made_rows(rows: DataFrame) -> Callable[[Broadcast], DataFrame]:
    """Products of sparse rows (i, j, x) and a shared basis."""

    def lines(shared: Broadcast) -> DataFrame:
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                j, x = (batch.column(k) for k in (1, 2))
                # a row at a time: its entries times the width are held
                made = [x[k].values.to_numpy() @ shared.value[j[k].values.to_numpy()] for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], ["i", "y"])

        return rows.mapInArrow(multiply, "i long, y array<double>")

    return lines


#: Entries of rows that a task makes at once.
ENTRIES = 1 << 15


def _own_rows(held: Broadcast, window: int, negative: int) -> Callable[[Broadcast], DataFrame]:
    """Products of the rows that tasks make of a held graph and a shared basis."""
    spark, n = SparkSession.active(), len(held.value.nodes)
    strip = 1024
    tasks = max(1, min(-(-n // strip), max(8 * spark.sparkContext.defaultParallelism, n >> 14)))

    def lines(shared: Broadcast) -> DataFrame:
        def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            h, basis = held.value, shared.value
            scale = float(h.deg.sum()) / (negative * window)
            for batch in batches:
                for task in batch.column(0).to_pylist():
                    for lo in range(task * strip, n, tasks * strip):
                        at = np.arange(lo, min(n, lo + strip))
                        yield pa.RecordBatch.from_arrays([pa.array(at), _lists(_times(h, at, basis, window, scale))], ["i", "y"])

        return spark.range(0, tasks, 1, tasks).mapInArrow(multiply, "i long, y array<double>")

    return lines


def _times(h, at: np.ndarray, basis: np.ndarray, window: int, scale: float) -> np.ndarray:
    """The rows of the positions ``at`` of log(max(1, scale * sum of walk steps * D^-1)), times the basis."""
    out = np.zeros((len(at), basis.shape[1]))
    to, of = h.around(at)
    met = np.cumsum(np.bincount(of, h.deg[to] if window > 1 else None, len(at)))
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(met, ENTRIES + (met[lo - 1] if lo else 0), "right")))
        key, x = np.arange(lo, hi) << 32 | at[lo:hi], np.ones(hi - lo)
        keys, steps = [], []
        for k in range(window):
            j = key & 0xFFFFFFFF
            to, of = h.around(j)
            key, x = (key >> 32 << 32)[of] | to, (x / h.deg[j])[of]
            if k + 1 < window:
                key, x = _summed(key, x)
            keys.append(key)
            steps.append(x)
        key, x = _summed(np.concatenate(keys), np.concatenate(steps))
        j = key & 0xFFFFFFFF
        x = np.log(np.maximum(scale * x / h.deg[j], 1.0))
        live = x > 0
        row, j, x = (key >> 32)[live], j[live], x[live]
        if len(row):
            begin = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            lines = np.take(basis, j, axis=0, mode="clip")
            lines *= x[:, None]
            out[row[begin]] = np.add.reduceat(lines, begin, axis=0)
        lo = hi
    return out


def _summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their sums."""
    order = np.argsort(key)
    key = key[order]
    begin = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    return key[begin], np.add.reduceat(x[order], begin) if len(begin) else x


def _leading(spark: SparkSession, lines: Callable[[Broadcast], DataFrame], n: int, dim: int, width: int, rounds: int = 12) -> np.ndarray:
    """The leading ``dim`` eigenvectors of a symmetric matrix, each times the root of its value's size, by subspace iteration:
    ``lines`` are (i, y), its rows times the n x width basis, which tasks multiply and the driver orthogonalises."""

    def product(basis: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast(basis)
        got = lines(shared).toArrow()
        out = np.zeros((n, width))
        if got.num_rows:
            out[got.column("i").to_numpy()] = np.concatenate([c.flatten().to_numpy() for c in got.column("y").chunks]).reshape(-1, width)
        shared.destroy()
        return out

    basis = np.linalg.qr(np.random.default_rng(42).normal(size=(n, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(product(basis))[0]
    small = basis.T @ product(basis)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values))[:dim]
    vec = basis @ turn[:, order]
    vec *= np.sign(vec[np.abs(vec).argmax(0), np.arange(len(order))] + 1e-300)  # one sign for each vector
    return vec * np.sqrt(np.abs(values[order]))


def factor_pairs(factors: DataFrame, epsilon: float, edges: DataFrame | None = None) -> DataFrame:
    """(u, v, score) from (node, c, f): sum over components of f_u f_v, of terms of at least epsilon over the
    number of components; a node's factor below the root of that can't be part of any and is left out only
    where its partner can't make up for it. Up to held.HELD numbers of live factors, counted, go to every task, which sums
    the pairs of its nodes on its own; beyond, each term is a joined row."""
    from edgesmith.operators import held

    r = factors.select("c").distinct().count()
    bar = epsilon / max(1, r)
    top = factors.groupBy("c").agg(F.max("f").alias("top"))
    live = factors.join(F.broadcast(top), "c").where((F.col("f") > 0) & (F.col("f") * F.col("top") >= bar)).select("node", "c", "f")
    known = live.where("node is not null")
    n, odd = known.agg(F.count(F.lit(1)), F.count_if(F.isnan("f") | (F.col("f") == float("inf")))).first()
    if bar > 0 and not odd and 3 * n <= held.HELD and all(isinstance(factors.schema[k].dataType, T.IntegralType) for k in ("node", "c")):
        rows = known.select(F.col("node").cast("long"), F.col("c").cast("long"), F.col("f").cast("double")).toArrow()
        out = held.factor_terms(factors.sparkSession, held.Columns(*(rows.column(k).to_numpy() for k in ("node", "c", "f"))), bar)
    else:
        a, b = live.select(F.col("node").alias("u"), "c", F.col("f").alias("x")), live.select(F.col("node").alias("v"), "c", F.col("f").alias("y"))
        out = a.join(b, "c").where((F.col("u") < F.col("v")) & (F.col("x") * F.col("y") >= bar)).groupBy("u", "v").agg(F.round(F.sum(F.col("x") * F.col("y")), 9).alias("score"))
    return out if edges is None else out.join(edges.select("u", "v"), ["u", "v"], "left_anti")


def union_best(parts: list[DataFrame], k: int) -> DataFrame:
    """Best score of each pair over all parts, and of those the best k."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("u", "v").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "u", "v").limit(k)


def in_bags(graph: Graph, members: DataFrame) -> DataFrame:
    """(bag, u, v): the edges among the members (bag, node) of each bag."""
    e = graph.edges.select("u", "v").join(members.withColumnRenamed("node", "u"), "u").join(members.withColumnRenamed("node", "v"), ["bag", "v"])
    return e.select("bag", "u", "v")


def filter_bags(edges: DataFrame, rho: float = 0.75) -> DataFrame:
    """(bag, u, v): of each bag the int(m * rho) edges with the largest least-end degree inside the bag, ties by (u, v)."""
    ends = edges.select("bag", F.explode(F.array("u", "v")).alias("node")).groupBy("bag", "node").agg(F.count(F.lit(1)).alias("deg"))
    e = edges.join(ends.select("bag", F.col("node").alias("u"), F.col("deg").alias("du")), ["bag", "u"]).join(ends.select("bag", F.col("node").alias("v"), F.col("deg").alias("dv")), ["bag", "v"])
    size = edges.groupBy("bag").agg(F.count(F.lit(1)).alias("m"))
    rank = F.row_number().over(Window.partitionBy("bag").orderBy(F.desc(F.least("du", "dv")), "u", "v"))
    return e.withColumn("r", rank).join(size, "bag").where(F.col("r") <= F.floor(F.col("m") * rho)).select("bag", "u", "v")


def symmetric_nmf(edges: DataFrame, rank: int = 8, iterations: int = 50, beta: float = 0.5, seed: int = 42) -> DataFrame:
    """(bag, node, c, f): non-negative F with F F' near each bag's adjacency; damped multiplicative steps, stopped
    when the error grows. A bag is one task's work, in memory proportional to its edges and its nodes times the rank:
    neither the adjacency nor F F' is ever made."""
    import pandas as pd

    def factor(key, pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf.u, pdf.v]))
        i, j = np.searchsorted(nodes, pdf.u), np.searchsorted(nodes, pdf.v)
        rows, columns = np.concatenate([i, j]), np.concatenate([j, i])
        order = np.argsort(rows, kind="stable")
        rows, columns = rows[order], columns[order]
        first = np.searchsorted(rows, np.arange(len(nodes)))  # every node has an edge
        f = np.random.default_rng(seed + int(key[0])).random((len(nodes), rank))
        error = np.inf
        for _ in range(iterations):
            new = f * (1 - beta + beta * np.add.reduceat(f[columns], first) / np.maximum(f @ (f.T @ f), 1e-12))
            now = len(rows) - 2 * float((new[rows] * new[columns]).sum()) + float(((new.T @ new) ** 2).sum())  # squared Frobenius
            if now > error:
                break
            f, error = new, now
        at = np.argwhere(f > 1e-9)
        return pd.DataFrame({"bag": int(key[0]), "node": nodes[at[:, 0]], "c": at[:, 1], "f": f[at[:, 0], at[:, 1]]})

    return edges.groupBy("bag").applyInPandas(factor, "bag long, node long, c long, f double")


def factor_error(edges: DataFrame, factors: DataFrame) -> DataFrame:
    """(bag, error): the Frobenius norm of each bag's adjacency less F F', by joins: |W|^2 - 2 <W, F F'> + |F'F|^2."""
    x, y = (factors.select("bag", F.col("node").alias(c), "c", F.col("f").alias(f"f{c}")) for c in ("u", "v"))
    inner = edges.join(x, ["bag", "u"]).join(y, ["bag", "v", "c"]).groupBy("bag").agg(F.sum(2 * F.col("fu") * F.col("fv")).alias("inner"))
    size = edges.groupBy("bag").agg((2 * F.count(F.lit(1))).alias("w"))
    a, b = factors.select("bag", "node", F.col("c").alias("c1"), F.col("f").alias("f1")), factors.select("bag", "node", F.col("c").alias("c2"), F.col("f").alias("f2"))
    gram = a.join(b, ["bag", "node"]).groupBy("bag", "c1", "c2").agg(F.sum(F.col("f1") * F.col("f2")).alias("g")).groupBy("bag").agg(F.sum(F.col("g") * F.col("g")).alias("gram"))
    square = F.col("w") - 2 * F.coalesce("inner", F.lit(0.0)) + F.coalesce("gram", F.lit(0.0))
    return size.join(inner, "bag", "left").join(gram, "bag", "left").select("bag", F.round(F.sqrt(F.greatest(square, F.lit(0.0))), 9).alias("error"))


def sorted_columns(factors: DataFrame, by: tuple[str, ...] = ("c",)) -> DataFrame:
    """factors with ``rk``: each column in descending order, cut where the zeros begin."""
    return factors.where("f > 0").withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("f"), "node")))


def nmf_ensemble(graph: Graph, k: int, bags: int = 4, share: float = 0.1, rank: int = 8, epsilon: float = 1.0, seed: int = 42, mode: str = "nodes", rho: float | None = 0.75) -> DataFrame:
    """(u, v, score): best pairs over all bags' factors, without edges. ``mode`` says how bags grow (nodes, edges or
    biased edges); ``rho`` is the share of a bag's edges that are factored."""
    from edgesmith.operators import sampling

    edges = in_bags(graph, cut(sampling.bags(graph, bags, share, seed, mode)))
    factors = cut(symmetric_nmf(edges if rho is None else filter_bags(edges, rho), rank, seed=seed))
    keyed = sorted_columns(factors, ("bag", "c")).select("node", (F.col("bag") * rank + F.col("c")).alias("c"), "f", "bag")
    bar = epsilon / rank
    a, b = keyed.select(F.col("node").alias("u"), "c", "bag", F.col("f").alias("x")), keyed.select(F.col("node").alias("v"), "c", F.col("f").alias("y"))
    terms = a.join(b, "c").where((F.col("u") < F.col("v")) & (F.col("x") * F.col("y") >= bar))
    scored = terms.groupBy("bag", "u", "v").agg(F.sum(F.col("x") * F.col("y")).alias("score")).join(graph.edges.select("u", "v"), ["u", "v"], "left_anti")
    return union_best([scored.select("u", "v", "score")], k)


def recommend(users: DataFrame, items: DataFrame, n: int = 10, known: DataFrame | None = None, blocks: int | None = None) -> DataFrame:
    """(user, item, score, rk): for each user (id, vec) the n items of the largest product, without the ``known``
    (user, item). Vectors that a task can hold are ranked there; otherwise, or with ``blocks``, users meet items block by
    block, and each block keeps n a user before the last ranking."""
    from edgesmith.functions.portable import dot
    from edgesmith.operators import held
    from edgesmith.operators.knn import blocks_for

    best = lambda d, *by: d.withColumn("rk", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "item"))).where(F.col("rk") <= n)
    if blocks is None and (x := held.hold(users)) and (y := held.hold(items)) and (x.matrix.shape[1] == y.matrix.shape[1] or not len(x.ids) or not len(y.ids)):
        # so many more as the known of one user may be
        more = 0 if known is None else known.select("user", "item").distinct().groupBy("user").count().agg(F.max("count")).first()[0] or 0
        top = held.best_items(users.sparkSession, x, y, n + more)
        return best(top if known is None else top.join(known.select("user", "item"), ["user", "item"], "left_anti"), "user")
    blocks = blocks_for(items.count()) if blocks is None else blocks
    side = F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int")
    u = users.select(F.col("id").alias("user"), F.col("vec").alias("x"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    scored = u.join(items.select(F.col("id").alias("item"), F.col("vec").alias("y")).withColumn("b", side), "b").select("b", "user", "item", F.round(dot(F.col("x"), F.col("y")), 9).alias("score"))
    scored = scored if known is None else scored.join(known.select("user", "item"), ["user", "item"], "left_anti")
    return best(best(scored, "user", "b").drop("rk", "b"), "user")


def save_links(model: LogisticRegressionModel, emb: DataFrame, path: str, accuracy: float = 0.0) -> None:
    """A fitted link classifier, the vectors it reads and its accuracy, in a folder."""
    model.write().overwrite().save(f"{path}/model")
    emb.write.mode("overwrite").parquet(f"{path}/vectors")
    emb.sparkSession.createDataFrame([(accuracy,)], "accuracy double").write.mode("overwrite").json(f"{path}/accuracy")


def load_links(spark, path: str) -> tuple[LogisticRegressionModel, DataFrame, float]:
    return LogisticRegressionModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vectors"), spark.read.schema("accuracy double").json(f"{path}/accuracy").first()[0]


def hits(graph: Graph, rounds: int = 10) -> DataFrame:
    """(node, authority) of the symmetric graph: power iteration, scaled to sum 1 each round."""
    adj = cut(graph.adj)
    h = cut(degrees(adj).select("node", F.lit(1.0).alias("a")))
    for _ in range(rounds):
        moved = adj.join(h.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("a").alias("a"))
        total = moved.agg(F.sum("a").alias("t"))
        h = cut(moved.join(F.broadcast(total)).select("node", (F.col("a") / F.col("t")).alias("a")))
    return h.select("node", F.col("a").alias("authority"))


def degree_centrality(graph: Graph) -> DataFrame:
    """(node, authority): degree over n - 1."""
    n = graph.size()[0]
    return graph.degree.select("node", (F.col("deg") / max(n - 1, 1)).alias("authority"))


def side_scaled(authority: DataFrame) -> DataFrame:
    """(node, x): authority scaled to 0..1 on each side (even and odd ids), 0 where all are alike."""
    side = F.pmod("node", F.lit(2))
    ends = authority.groupBy(side.alias("side")).agg(F.min("authority").alias("low"), F.max("authority").alias("high"))
    both = authority.withColumn("side", side).join(F.broadcast(ends), "side")
    return both.select("node", F.when(F.col("high") > F.col("low"), (F.col("authority") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0).alias("x"))


def walk_counts(scaled: DataFrame, most: int = 32, least: int = 1) -> DataFrame:
    """(node, walks): walks to start at each node."""
    return scaled.select("node", F.greatest(F.ceil(F.round(F.col("x") * most, 6)), F.lit(least)).cast("long").alias("walks"))


def walk_corpus(graph: Graph, starts: DataFrame, steps: int, stop: float = 0.15, seed: int = 42, hops: int = 2, restart: float = 0.0) -> DataFrame:
    """(node, walk, pos, at): walks of two hops a step, so on one side of a two-sided graph, or of one; before each step
    a walk ends with probability ``stop``, and in its place it is put back with probability ``restart``. Neighbours are
    drawn by digest among ascending ids."""
    near = stored(graph.adj.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("near")))[0]
    now, _ = stored(starts.select("node", F.explode(F.sequence(F.lit(1), F.col("walks").cast("int"))).alias("walk")).select("node", "walk", F.col("node").alias("at")))
    out = now.select("node", "walk", F.lit(0).alias("pos"), "at")
    bar = int(stop * (1 << 28))
    draw = lambda s, what: F.conv(F.substring(digest(seed, "node", "walk", F.lit(s), F.lit(what)), 1, 7), 16, 10).cast("long")
    for s in range(1, steps + 1):
        going = now.where(draw(s, "stop") >= bar)
        for half in ("one", "two")[:hops]:
            place = F.pmod(draw(s, half), F.size("near")).cast("int") + 1
            going = going.join(near, going["at"] == near["src"]).select("node", "walk", F.element_at("near", place).alias("at"))
        if restart:
            going = going.withColumn("at", F.when(draw(s, "restart") < int(restart * (1 << 28)), F.col("node")).otherwise(F.col("at")))
        now, _ = stored(going)
        out = out.unionByName(now.select("node", "walk", F.lit(s).alias("pos"), "at"))
    return out


def context_windows(walks: DataFrame, reach: int = 5) -> DataFrame:
    """(node, walk, pos, at, context): the walk's nodes at most ``reach`` places away, without the node itself."""
    w = Window.partitionBy("node", "walk").orderBy("pos").rowsBetween(-reach, reach)
    near = F.collect_list("at").over(w)
    return walks.withColumn("context", F.filter(near, lambda x: x != F.col("at")))


def skipgram_embedding(graph: Graph, walks: DataFrame, dim: int = 16, epochs: int = 5, rate: float = 0.05, gamma: float = 0.1, reach: int = 5, seed: int = 42, held: int = 1 << 25) -> tuple[DataFrame, list[float]]:
    """((id, vec), loss by epoch): vectors of a two-sided graph from first-order edges and walk contexts.

    Each epoch is one gradient step summed over all positive pairs and as many pairs drawn by digest, no parameter
    server. The loss is one number an epoch; the rate grows by 5 % while it falls and shrinks by 5 % otherwise. Up to ``held``
    numbers of vectors, counted, go to every task, which sums the pushes of its pairs, so no pair is joined; beyond, pairs are
    joined with both vectors.
    """
    start = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.conv(F.substring(digest(seed, "node", i), 1, 7), 16, 10).cast("double") / (1 << 28) - 0.5)
    nodes = graph.all_nodes().select("node")
    n, odd = nodes.agg(F.count(F.lit(1)), F.count_if(F.col("node").isNull())).first()
    if n and n * dim <= held and not odd and isinstance(nodes.schema["node"].dataType, T.IntegralType):
        return _skipgram_held(graph, walks, nodes.select(F.col("node").cast("long"), start.alias("vec")), n, dim, epochs, rate, gamma, reach, seed)
    near = walks.select(F.col("at").alias("a"), "node", "walk", "pos").join(walks.select(F.col("at").alias("b"), "node", "walk", F.col("pos").alias("other")), ["node", "walk"])
    pairs = near.where((F.abs(F.col("pos") - F.col("other")) <= reach) & (F.col("a") < F.col("b"))).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))
    pairs = pairs.unionByName(graph.edges.select(F.col("u").alias("a"), F.col("v").alias("b"), (F.lit(1.0) * gamma * 10).alias("w")))
    positive = pairs.groupBy("a", "b").agg(F.sum("w").alias("w")).withColumn("y", F.lit(1.0))
    ids = cut(row_numbers(graph.all_nodes().select("node"), "node").withColumnRenamed("rn", "pos"))
    n = ids.count()
    draw = F.pmod(F.conv(F.substring(digest(seed, "a", "b", F.lit("n")), 1, 7), 16, 10).cast("long"), F.lit(n)) + 1
    negative = positive.select("a", draw.alias("pos"), "w").join(ids, "pos").where("a <> node").select("a", F.col("node").alias("b"), "w", F.lit(0.0).alias("y"))
    samples = cut(positive.select("a", "b", "w", "y").unionByName(negative))
    vec, losses = cut(ids.select(F.col("node").alias("id"), start.alias("vec"))), []
    for _ in range(epochs):
        x, y = (vec.select(F.col("id").alias(c), F.col("vec").alias(f"v{c}")) for c in ("a", "b"))
        s = samples.join(x, "a").join(y, "b")
        p = 1 / (1 + F.exp(-F.aggregate(F.zip_with("va", "vb", lambda i, j: i * j), F.lit(0.0), lambda t, v: t + v)))
        s = cut(s.withColumn("p", p).withColumn("g", F.col("w") * (F.col("y") - F.col("p"))))
        losses.append(float(s.agg(-F.sum(F.col("w") * F.log(F.greatest(F.when(F.col("y") == 1, F.col("p")).otherwise(1 - F.col("p")), F.lit(1e-12))))).first()[0]))
        if len(losses) > 1:
            rate *= 1.05 if losses[-1] < losses[-2] else 0.95
        pushes = s.select(F.col("a").alias("id"), "g", F.col("vb").alias("o"), "w").unionByName(s.select(F.col("b").alias("id"), "g", F.col("va").alias("o"), "w"))
        total = pushes.groupBy("id").agg(F.sum("w").alias("w"), *[F.sum(F.col("g") * F.col("o")[i]).alias(f"d{i}") for i in range(dim)])
        move = F.array(*[F.col(f"d{i}") / F.col("w") for i in range(dim)])
        vec = cut(vec.join(total.select("id", move.alias("d")), "id", "left").select("id", F.when(F.col("d").isNull(), F.col("vec")).otherwise(F.zip_with("vec", "d", lambda a, b: a + rate * 10 * b)).alias("vec")))
    return vec, losses


#: Pairs of a pass that are counted and stored together, about; pairs whose pushes are summed at once.
PAIRS, LOT = 1 << 26, 1 << 19


def _walk_pairs(graph: Graph, walks: DataFrame, n: int, gamma: float, reach: int, seed: int) -> tuple[DataFrame, list[str]]:
    """(a, b, w, other): positive pairs, their weights and the place of the node that a meets instead of b; and their paths."""
    paths, path = stored(walks.groupBy("node", "walk").agg(F.collect_list(F.struct("pos", "at")).alias("steps")).select("steps"))
    many = F.size("steps")
    count = (paths.agg(F.sum(many * (many - 1) / 2)).first()[0] or 0) + graph.edges.count()
    passes = max(1, int(-(-count // PAIRS)))
    one = paths.select(F.explode("steps").alias("x"), "steps")
    two = one.select("x", F.explode(F.filter("steps", lambda y: (F.abs(y["pos"] - F.col("x")["pos"]) <= reach) & (F.col("x")["at"] < y["at"]))).alias("y"))
    pairs = two.select(F.col("x")["at"].cast("long").alias("a"), F.col("y")["at"].cast("long").alias("b"), F.lit(1.0).alias("w"))
    pairs = pairs.unionByName(graph.edges.select(F.col("u").cast("long").alias("a"), F.col("v").cast("long").alias("b"), (F.lit(1.0) * gamma * 10).alias("w")))
    other = F.pmod(F.conv(F.substring(digest(seed, "a", "b", F.lit("n")), 1, 7), 16, 10).cast("long"), F.lit(n))
    out, kept = None, []
    for i in range(passes):
        some = pairs.where(F.pmod(F.xxhash64("a"), F.lit(passes)) == i).groupBy("a", "b").agg(F.sum("w").alias("w"))
        made, where = stored(some.select("a", "b", "w", other.alias("other")))
        out = made if out is None else out.unionByName(made)
        kept.append(where)
    forget(graph.edges.sparkSession, path)
    return out, kept


def _pushes(a: np.ndarray, b: np.ndarray, w: np.ndarray, y: float, vec: np.ndarray, total: np.ndarray) -> float:
    """Adds what pairs of positions push both ends by, and their weights, to ``total``; their loss."""
    x, z = vec[a], vec[b]
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-(x * z).sum(1)))
    g = w * (y - p)
    for end, far in ((a, z), (b, x)):
        at, of = np.unique(end, return_inverse=True)
        for i in range(vec.shape[1]):
            total[at, i] += np.bincount(of, g * far[:, i])
        total[at, -1] += np.bincount(of, w)
    return -float((w * np.log(np.maximum(p if y else 1 - p, 1e-12))).sum())


def _skipgram_held(graph: Graph, walks: DataFrame, begin: DataFrame, n: int, dim: int, epochs: int, rate: float, gamma: float, reach: int, seed: int) -> tuple[DataFrame, list[float]]:
    spark = graph.edges.sparkSession
    first = begin.toArrow()
    nodes = first.column("node").to_numpy()
    order = np.argsort(nodes)
    nodes, vec = nodes[order], np.concatenate([c.flatten().to_numpy() for c in first.column("vec").chunks]).reshape(n, dim)[order]
    del first
    samples, paths = _walk_pairs(graph, walks, n, gamma, reach, seed)
    few = samples.coalesce(spark.sparkContext.defaultParallelism)
    names, losses, ids = [f"d{i}" for i in range(dim)] + ["w"], [], spark.sparkContext.broadcast(nodes)

    def epoch(shared: Broadcast) -> Callable:
        def push(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, v = ids.value, shared.value
            total, loss, lot = np.zeros((n, dim + 1)), 0.0, []

            def taken() -> float:
                a, b, w, other = (np.concatenate(c) for c in zip(*lot, strict=True))
                lot.clear()
                a, b = np.searchsorted(at, a), np.searchsorted(at, b)
                live = a != other
                return _pushes(a, b, w, 1.0, v, total) + _pushes(a[live], other[live], w[live], 0.0, v, total)

            for batch in batches:
                lot.append([batch.column(c).to_numpy() for c in range(4)])
                if sum(len(x[0]) for x in lot) >= LOT:
                    loss += taken()
            if lot:
                loss += taken()
            live = np.flatnonzero(total[:, -1])
            for lo in range(0, len(live), LOT):
                some = live[lo : lo + LOT]
                yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(total[some, i]) for i in range(dim + 1))], ["i", *names])
            yield pa.RecordBatch.from_arrays([pa.array([-1]), *(pa.array([loss]) for _ in names)], ["i", *names])

        return push

    for _ in range(epochs):
        shared = spark.sparkContext.broadcast(vec)
        made = few.mapInArrow(epoch(shared), ", ".join(["i long", *(f"{c} double" for c in names)]))
        got = made.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).toArrow()
        shared.destroy()
        i, w = got.column("i").to_numpy(), got.column("w").to_numpy()
        losses.append(float(w[i < 0].sum()))
        if len(losses) > 1:
            rate *= 1.05 if losses[-1] < losses[-2] else 0.95
        vec, live = vec.copy(), i >= 0
        for c in range(dim):
            vec[i[live], c] += rate * 10 * (got.column(names[c]).to_numpy()[live] / w[live])
    for path in paths:
        forget(spark, path)
    return spark.createDataFrame(pa.table({"id": nodes, "vec": _lists(vec)}), "id long, vec array<double>"), losses


def landmarks(nodes: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """min(int(10 log2 n), n) nodes drawn by digest."""
    import math

    return nodes.orderBy(digest(seed, "node"), "node").limit(min(int(10 * math.log2(max(n, 1))) if n > 1 else 1, n))
