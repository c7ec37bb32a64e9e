"""Truncated personalised PageRank and the candidates it gives; exact PageRank; random walks with restart.

State is one row (q, v, p, rk) for each source and node it reaches. A step is a join of the adjacency with
the state on the neighbour, a sum, and a rank within the source, whose limit follows the source's degree, so
the state stays within a constant times the edges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from edgesmith.functions.lineage import cut
from edgesmith.functions.md5 import Prefixes
from edgesmith.functions.portable import digest, digest_int
from edgesmith.operators import walkblocks
from edgesmith.operators.graph import Graph, cross_side
from edgesmith.operators.held import first


def _ranked(pi: DataFrame) -> DataFrame:
    return pi.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(F.round("p", 12)), "v")))


@dataclass
class TruncatedPageRank:
    """``damping`` is the probability of going on; ``keep`` times a node's share of the budget is how many
    nodes it remembers."""

    graph: Graph
    budget: int
    damping: float = 0.8
    epsilon: float = 0.05
    keep: float = 20
    max_iterations: int = 9
    min_iterations: int = 3
    bipartite: bool = False

    def __post_init__(self):
        self.ratios: list[float] = []

    @cached_property
    def share(self) -> float:
        n, m = self.graph.size()
        return (self.budget / n) / ((2 * m) / n) if m else 0.0

    @cached_property
    def limits(self) -> DataFrame:
        deg = self.graph.degree.withColumn("k", F.col("deg") * F.lit(self.share))
        return cut(deg.select(F.col("node").alias("q"), "deg", "k", F.ceil(F.col("k") * self.keep).alias("trunc")))

    @cached_property
    def adj(self) -> DataFrame:
        return cut(self.graph.adj.select(F.col("src").alias("q"), F.col("dst").alias("nb")).join(self.limits.select("q", "deg", "trunc"), "q"))

    def start(self) -> DataFrame:
        return self.limits.select("q", F.col("q").alias("v"), F.lit(1.0).alias("p"), F.lit(1).alias("rk"))

    def step(self, pi: DataFrame) -> DataFrame:
        a = self.damping
        moved = self.adj.join(pi.select(F.col("q").alias("nb"), "v", "p", "rk"), "nb").where(F.col("rk") <= F.col("trunc"))
        mass = moved.select("q", "v", (F.lit(a) / F.col("deg") * F.col("p")).alias("p"), "trunc")
        mass = mass.unionByName(self.limits.select("q", F.col("q").alias("v"), F.lit(1 - a).alias("p"), "trunc"))
        # dealt by source once, for the sum and the rank: rows of one (q, v) come by different neighbours, so that sums
        # before the shuffle would save little
        summed = _ranked(mass.repartition("q").groupBy("q", "v").agg(F.sum("p").alias("p"), F.first("trunc").alias("trunc")))
        return summed.where(F.col("rk") <= F.col("trunc")).select("q", "v", "p", "rk")

    def change(self, old: DataFrame, new: DataFrame) -> DataFrame:
        """One row: delta and total; an entry on both sides counts twice in both, as the stopping rule has it."""
        o, n = old.select("q", "v", F.col("p").alias("a")), new.select("q", "v", F.col("p").alias("b"))
        both = o.join(n, ["q", "v"], "full_outer")
        w = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 2.0).otherwise(1.0)
        a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
        return both.agg(F.sum(w * F.abs(a - b)).alias("delta"), F.sum(w * a).alias("total"))

    def state(self, iterations: int | None = None) -> DataFrame:
        """After so many iterations, or until delta / total falls below epsilon. One row an iteration
        reaches the driver."""
        pi = self.start()
        for i in range(self.max_iterations if iterations is None else iterations):
            new = cut(self.step(pi))
            if iterations is None:
                row = self.change(pi, new).first()
                self.ratios.append(row["delta"] / row["total"] if row["total"] else 0.0)
            pi = new
            if iterations is None and i + 1 >= self.min_iterations and self.ratios[-1] < self.epsilon:
                break
        return pi

    def candidates(self, pi: DataFrame) -> DataFrame:
        """(u, v): each source's first floor(k) eligible nodes, then the best of its next ceil(k) until the
        budget is reached."""
        edges = self.graph.adj.select(F.col("src").alias("q"), F.col("dst").alias("v"))
        free = pi.where("q <> v").join(edges, ["q", "v"], "left_anti")
        if self.bipartite:
            free = free.where(cross_side(F.col("q"), F.col("v")))
        free = free.withColumn("er", F.row_number().over(Window.partitionBy("q").orderBy("rk"))).join(self.limits.select("q", "k"), "q")
        pairs = free.select(F.least("q", "v").alias("u"), F.greatest("q", "v").alias("v"), F.round("p", 12).alias("p"), "er", "k")
        picks = cut(pairs.where(F.col("er") <= F.floor("k")).select("u", "v").distinct())
        pool = pairs.where((F.col("er") > F.floor("k")) & (F.col("er") <= F.floor("k") + F.ceil("k"))).groupBy("u", "v").agg(F.max("p").alias("p")).join(picks, ["u", "v"], "left_anti")
        fill = pool.orderBy(F.desc("p"), "u", "v").limit(max(0, self.budget - picks.count())).select("u", "v")
        return picks.unionByName(fill)

    def run(self, iterations: int | None = None) -> DataFrame:
        """``candidates`` of ``state``; between integers by blocks, which shuffle no term and write no row of a state."""
        if self.keep <= 0 or any(not isinstance(self.graph.edges.schema[c].dataType, T.IntegralType) for c in ("u", "v")):
            return self.candidates(self.state(iterations))
        nodes = None if self.graph.nodes is None else self.graph.nodes.count()
        found, self.ratios = walkblocks.walk(self.graph.edges, self.budget, self.damping, self.epsilon, self.keep, self.max_iterations, self.min_iterations, self.bipartite, iterations, nodes)
        return found


#: Most directed edges (8 bytes each) that every task holds; graphs beyond it are walked by joins.
HELD = 1 << 24
#: Sources that are ranked together, the places in a row of neighbours that are summed one by one, and for how many rows at once.
SOURCES, PLACES, CHUNK = 32, 64, 4096
#: Sources whose dense sums are taken at once: rows of 32 bytes, which numpy gathers fastest, of a block that stays in a core's cache.
COLUMNS = 4
#: Sources of a task that ranks them, about: each may take sums over all of the graph, so that few large tasks would end far apart.
RANKED = 256
#: Walkers that step together, and those whose visits are given out together.
WALKERS, GIVEN = 8192, 512


class Held:
    """The adjacency of a graph of at most HELD directed edges, by node positions, for Arrow tasks."""

    def __init__(self, edges: DataFrame):
        rows = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).toArrow()
        u, v = rows.column("u").to_numpy(), rows.column("v").to_numpy()
        self.nodes = np.unique(np.concatenate([np.unique(u), np.unique(v)]))
        u, v = (np.searchsorted(self.nodes, x).astype(np.int32) for x in (u, v))
        src, dst = np.concatenate([u, v]), np.concatenate([v, u])
        self.to = dst[np.lexsort((dst, src))]
        self.deg = np.bincount(src, minlength=len(self.nodes)).astype(np.int64)
        self.first = np.cumsum(self.deg) - self.deg

    def place(self, node: int) -> int:
        """The node's position, or -1 for one without edges."""
        at = int(np.searchsorted(self.nodes, node))
        return at if at < len(self.nodes) and self.nodes[at] == node else -1

    def around(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The neighbours of all positions in a row, and of which position (by its place in ``at``) each is one."""
        size = self.deg[at]
        of = np.repeat(np.arange(len(at)), size)
        return self.to[np.arange(len(of)) + np.repeat(self.first[at] - (np.cumsum(size) - size), size)], of


def _held(edges: DataFrame, most: int):
    """A broadcast of the adjacency, or None if it is too large."""
    return edges.sparkSession.sparkContext.broadcast(Held(edges)) if 2 * edges.count() <= most else None


class Near:
    """The part of a held graph within so many steps of some positions, laid out to sum neighbours' rows: positions by
    falling degree, so that the k-th neighbours of all that have one are taken at once."""

    def __init__(self, h: Held, inside: np.ndarray):
        at = np.flatnonzero(inside)
        to, of = h.around(at)
        kept = inside[to]
        to, of = to[kept], of[kept]
        size = np.bincount(of, minlength=len(at))
        order = np.argsort(-size, kind="stable")
        self.inside, self.at, size = inside, at[order], size[order]
        self.rank = np.zeros(len(inside), np.int64)
        self.rank[self.at] = np.arange(len(at))
        begin = (np.cumsum(np.bincount(of, minlength=len(at))) - np.bincount(of, minlength=len(at)))[order]
        local = self.rank[to]
        self.steps = [local[begin[:many] + k] for k in range(min(PLACES, int(size.max(initial=0)))) if (many := int((size > k).sum()))]
        hubs = int((size > PLACES).sum())
        more = size[:hubs] - PLACES
        self.rest = local[np.arange(int(more.sum())) + np.repeat(begin[:hubs] + PLACES - (np.cumsum(more) - more), more)]
        self.cuts = np.cumsum(more) - more

    def sums(self, p: np.ndarray, out: np.ndarray) -> None:
        """Into ``out`` the sums of the neighbours' rows of p."""
        held, some = np.empty((CHUNK, p.shape[1])), len(self.steps[0]) if self.steps else 0
        if some:
            np.take(p, self.steps[0], axis=0, out=out[:some], mode="clip")
        out[some:] = 0
        for near in self.steps[1:]:
            for lo in range(0, len(near), CHUNK):
                some = near[lo : lo + CHUNK]
                np.take(p, some, axis=0, out=held[: len(some)], mode="clip")
                out[lo : lo + len(some)] += held[: len(some)]
        if len(self.cuts):
            for c in range(p.shape[1]):  # a column at a time: a hub's neighbours are not held for all
                out[: len(self.cuts), c] += np.add.reduceat(p[self.rest, c], self.cuts)


#: A row of a sorted sum costs about as much as so many of a dense one; up to FEW rows that isn't asked.
DENSE, FEW = 20, 1 << 18


class Ranks:
    """Untruncated walks from some sources at once: sorted lists of what they reach, and sums over all that is near as soon
    as the lists would cost more."""

    def __init__(self, h: Held, damping: float, iterations: int):
        self.h, self.damping, self.iterations, self.near = h, damping, iterations, None

    def of(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions and p for each position of ``own``."""
        if not len(own):
            return
        h, n, back = self.h, len(self.h.nodes), 1 - self.damping
        home = np.arange(len(own)) * n + own
        key, p = home, np.ones(len(own))
        for i in range(self.iterations):
            at = key % n
            rows = int(h.deg[at].sum())
            if rows > FEW:
                inside = self._within(at, self.iterations - i)
                if rows * DENSE > len(own) * int(h.deg[inside].sum()):
                    yield from self._dense(key, p, own, inside, self.iterations - i)
                    return
            to, of = h.around(at)
            every = np.concatenate([(key // n)[of] * n + to, home])
            mass = np.concatenate([(self.damping * p / h.deg[at])[of], np.full(len(own), back)])
            order = np.argsort(every, kind="stable")
            every = every[order]
            begin = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
            key, p = every[begin], np.add.reduceat(mass[order], begin)
        cuts = np.searchsorted(key, np.arange(len(own) + 1) * n)
        for r, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            yield key[lo:hi] - r * n, p[lo:hi]

    def _within(self, at: np.ndarray, steps: int) -> np.ndarray:
        inside, edge = np.zeros(len(self.h.nodes), bool), np.unique(at)
        inside[edge] = True
        for _ in range(steps):
            to = self.h.around(edge)[0]
            met = np.zeros(len(inside), bool)
            met[to] = True
            edge = np.flatnonzero(met & ~inside)
            if not len(edge):
                break
            inside[edge] = True
        return inside

    def _dense(self, key: np.ndarray, p: np.ndarray, own: np.ndarray, inside: np.ndarray, steps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n = len(self.h.nodes)
        if self.near is None or not np.array_equal(inside, self.near.inside):
            self.near = Near(self.h, inside)
        near = self.near
        share = (self.damping / self.h.deg[near.at])[:, None]
        for left in range(0, len(own), COLUMNS):
            home = near.rank[own[left : left + COLUMNS]]
            lo, hi = np.searchsorted(key, [left * n, (left + len(home)) * n])
            dense = np.zeros((len(near.at), len(home)))
            dense[near.rank[key[lo:hi] % n], key[lo:hi] // n - left] = p[lo:hi]
            moved = np.empty_like(dense)
            for _ in range(steps):
                # the graph is symmetric: what comes to a node comes from its neighbours
                np.multiply(dense, share, out=moved)
                near.sums(moved, dense)
                dense[home, np.arange(len(home))] += 1 - self.damping
            for column in np.ascontiguousarray(dense.T):
                yield near.at, column


def _pagerank_held(held, sources: DataFrame, k: int, damping: float, iterations: int) -> DataFrame:
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        ranks = Ranks(h, damping, iterations)
        for batch in batches:
            ids = sorted(q for q in batch.column(0).to_pylist() if q is not None)
            for lo in range(0, len(ids), SOURCES):
                own = [(q, at) for q in ids[lo : lo + SOURCES] if (at := h.place(q)) >= 0]
                out: list[list] = [[], [], []]
                for (q, at), (places, p) in zip(own, ranks.of(np.array([at for _, at in own], np.int64)), strict=True):
                    around = h.to[h.first[at] : h.first[at] + h.deg[at]]
                    free = np.flatnonzero((p > 0) & (places != at))
                    # neighbours among the first count, too, so as many more are taken before they go
                    best = free[first((-np.round(p[free], 12), places[free]), k + len(around))]
                    best = best[~np.isin(places[best], around)][:k]
                    out[0] += [q] * len(best)
                    out[1] += h.nodes[places[best]].tolist()
                    out[2] += np.round(p[best], 9).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["q", "v", "p"])

    return _near_sources(sources, len(held.value.nodes), RANKED).mapInArrow(rank, "q long, v long, p double")


def _near_sources(sources: DataFrame, n: int, each: int) -> DataFrame:
    """Sources dealt by range, about ``each`` of the n a task."""
    return sources.select(F.col("node").cast("long")).repartitionByRange(max(sources.sparkSession.sparkContext.defaultParallelism, n // each), "node")


def pagerank(graph: Graph, sources: DataFrame, k: int, damping: float = 0.8, iterations: int = 20, held: int = HELD) -> DataFrame:
    """(q, v, p): the k best non-neighbours of each source by untruncated personalised PageRank.

    A graph of at most ``held`` directed edges, counted, goes to every task, which ranks SOURCES sources at a time over what they reach.
    Beyond, ``sources`` (node) come in blocks of a size that the caller chooses: state is sources times nodes reached.
    """
    if small := _held(graph.edges, held):
        return _pagerank_held(small, sources, k, damping, iterations)
    sources = cut(sources.select(F.col("node").alias("q")))
    adj = cut(graph.adj.join(graph.degree.select(F.col("node").alias("src"), "deg"), "src"))
    pi = sources.select("q", F.col("q").alias("v"), F.lit(1.0).alias("p"))
    restart = sources.select("q", F.col("q").alias("v"), F.lit(1 - damping).alias("p"))
    for _ in range(iterations):
        moved = pi.join(adj, pi["v"] == adj["src"]).select("q", F.col("dst").alias("v"), (F.lit(damping) * F.col("p") / F.col("deg")).alias("p"))
        pi = cut(moved.unionByName(restart).groupBy("q", "v").agg(F.sum("p").alias("p")))
    edges = adj.select(F.col("src").alias("q"), F.col("dst").alias("v"))
    free = pi.where("q <> v").join(edges, ["q", "v"], "left_anti")
    return _ranked(free).where(F.col("rk") <= k).select("q", "v", F.round("p", 9).alias("p"))


def _walks_held(held, sources: DataFrame, steps: int, limit: int, seed: int, k: int | None = None) -> DataFrame:
    """All visits, or each source's ``k`` most visited nodes that are neither itself nor neighbours."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = held.value
        # a task's sources are about WALKERS; digests of few texts at once cost more
        ids = [q for batch in batches for q in batch.column(0).to_pylist() if q is not None and h.place(q) >= 0]
        ids.sort(key=lambda q: (len(str(q)), q))
        for _, alike in groupby(ids, lambda q: len(str(q))):
            alike = list(alike)
            for lo in range(0, len(alike), WALKERS):
                own = np.array(alike[lo : lo + WALKERS], np.int64)
                start = np.searchsorted(h.nodes, own)
                seen = _steps(h, start, Prefixes([f"{seed}|{q}|".encode() for q in own.tolist()]), steps, limit)
                for g in range(0, len(own), GIVEN):
                    some = slice(g, g + GIVEN)
                    row, v, visits = _tally(seen[:, some])
                    if k is not None:
                        row, v, visits = _free(h, start[some], row, v, visits, k)
                    columns = own[some][row], h.nodes[v], visits
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "v", "visits"])

    return _near_sources(sources, len(held.value.nodes), WALKERS).mapInArrow(walk, "q long, v long, visits long")


def _steps(h: Held, start: np.ndarray, texts: Prefixes, steps: int, limit: int) -> np.ndarray:
    """The positions that walkers come to, a row a step."""
    seen, at = np.empty((steps, len(start)), np.int32), start
    for s in range(steps):
        seen[s] = h.to[h.first[at] + texts.first28(f"{s}|step".encode()) % h.deg[at]]
        at = np.where(texts.first28(f"{s}|back".encode()) < limit, start, seen[s])
    return seen


def _tally(seen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(walker, position, visits), ascending."""
    steps, n = seen.shape
    flat = np.sort(seen.T, axis=1).ravel()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[::steps] = True
    begin = np.flatnonzero(new)
    return begin // steps, flat[begin], np.diff(np.append(begin, len(flat)))


def _free(h: Held, start: np.ndarray, row: np.ndarray, v: np.ndarray, visits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    to, of = h.around(start)
    known = np.sort(np.concatenate([of * len(h.nodes) + to, np.arange(len(start)) * len(h.nodes) + start]))
    key = row * len(h.nodes) + v
    keep = known[np.minimum(np.searchsorted(known, key), len(known) - 1)] != key
    row, v, visits = row[keep], v[keep], visits[keep]
    if len(row):  # fewer visits than the k-th of a walker go before the sort
        most = int(visits.max()) + 1
        above = np.bincount(row * most + visits, minlength=len(start) * most).reshape(-1, most)[:, ::-1].cumsum(1)
        keep = visits >= most - 1 - np.minimum((above < k).sum(1), most - 1)[row]
        row, v, visits = row[keep], v[keep], visits[keep]
    order = np.lexsort((v, -visits, row))
    row, v, visits = row[order], v[order], visits[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[best], v[best], visits[best]


def restart_walks(graph: Graph, sources: DataFrame, steps: int = 1000, restart: float = 0.1, seed: int = 42, held: int = HELD) -> DataFrame:
    """(q, v, visits): one walker a source. Each step goes to the neighbour whose place in ascending order is
    the step's digest modulo the degree; then, with probability ``restart``, the walker is put back. A graph of at most
    ``held`` directed edges, counted, goes to every task, which walks on its own; beyond, each step is a join."""
    if small := _held(graph.edges, held):
        return _walks_held(small, sources, steps, int(restart * (1 << 28)), seed)
    adj = graph.adj.withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).join(graph.degree.select(F.col("node").alias("src"), "deg"), "src")
    adj = cut(adj)
    walkers = sources.select(F.col("node").alias("q"), F.col("node").alias("at"))
    limit = int(restart * (1 << 28))
    seen = []
    for s in range(steps):
        draw = F.pmod(digest_int(digest(seed, "q", F.lit(s), F.lit("step"))), F.col("deg"))
        back = digest_int(digest(seed, "q", F.lit(s), F.lit("back"))) < limit
        hop = walkers.join(adj, walkers["at"] == adj["src"]).where(F.col("i") == draw)
        moved = hop.select("q", F.col("dst").alias("v"), F.when(back, F.col("q")).otherwise(F.col("dst")).alias("at"))
        moved = cut(moved)
        seen.append(moved.select("q", "v"))
        walkers = moved.select("q", "at")
        if len(seen) == 16:  # keep the union short
            seen = [cut(_count(seen))]
    return _count(seen).groupBy("q", "v").agg(F.sum("visits").alias("visits"))


def _count(parts: list[DataFrame]) -> DataFrame:
    out = None
    for p in parts:
        p = p if "visits" in p.columns else p.withColumn("visits", F.lit(1).cast("long"))
        out = p if out is None else out.unionByName(p)
    return out.groupBy("q", "v").agg(F.sum("visits").alias("visits"))


def walk_candidates(graph: Graph, visits: DataFrame, k: int, bipartite: bool = False) -> DataFrame:
    """(q, v, visits): each source's k most visited nodes that are neither itself nor neighbours."""
    edges = graph.adj.select(F.col("src").alias("q"), F.col("dst").alias("v"))
    free = visits.where("q <> v").join(edges, ["q", "v"], "left_anti")
    if bipartite:
        free = free.where(cross_side(F.col("q"), F.col("v")))
    return free.withColumn("rk", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("visits"), "v"))).where(F.col("rk") <= k).drop("rk")


def restart_candidates(graph: Graph, sources: DataFrame, k: int, steps: int = 1000, restart: float = 0.1, seed: int = 42, held: int = HELD) -> DataFrame:
    """``walk_candidates`` of ``restart_walks``; where every task holds the graph, visits are ranked where they are made."""
    if small := _held(graph.edges, held):
        return _walks_held(small, sources, steps, int(restart * (1 << 28)), seed, k)
    return walk_candidates(graph, restart_walks(graph, sources, steps, restart, seed, 0), k)


def budget_per_node(pairs: int, n: int) -> int:
    return math.ceil(pairs / n)
